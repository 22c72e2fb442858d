"""Operators for preparing language-model training data.

Self-contained: nothing outside this folder imports it.  ``queries.py`` holds
the registered ``opN_*`` queries, one module per operator holds the rest.
"""
