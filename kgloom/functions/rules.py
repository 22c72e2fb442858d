"""Column functions of Horn rules as text: their parts, confidence, shape, and whether they are to be applied."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to the predictions of a rule before dividing.
UNSEEN = 5
ATOM = r"^(.+)\((.*),(.*)\)$"


def head_relation(rule: Column) -> Column:
    """The relation of the head; the empty text if there is none."""
    head = F.substring_index(rule, " <= ", 1)
    return F.when(F.instr(head, "(") > 0, F.substring_index(head, "(", 1)).otherwise(F.lit(""))


def atom(text: Column) -> Column:
    part = lambda n: F.regexp_extract(text, ATOM, n)
    return F.struct(part(1).alias("rel"), part(2).alias("x"), part(3).alias("y"))


def head(rule: Column) -> Column:
    return atom(F.split(rule, " <= ")[0])


def body(rule: Column) -> Column:
    """The atoms of the body; null unless there is exactly one arrow."""
    parts = F.split(rule, " <= ")
    return F.when(F.size(parts) == 2, F.transform(F.split(parts[1], ", "), atom))


def count_of(text: Column) -> Column:
    """A count that may be written with a fraction; 0 if it is no number."""
    return F.coalesce(text.try_cast("double").try_cast("long"), F.lit(0).cast("long"))


def confidence(preds: Column, true: Column, unseen: int = UNSEEN) -> Column:
    return F.when(preds > 0, true / (preds + unseen)).otherwise(F.lit(0.0))


def is_trivial(rule: Column) -> Column:
    """One body atom that repeats the head's variables, or a constant of the head."""
    h, b = head(rule), body(rule)
    first = b[0]

    def constant(c):
        return ~c.rlike("^[A-Z]$")

    same = ((first["x"] == "X") & (first["y"] == "Y")) | ((first["x"] == "Y") & (first["y"] == "X"))
    again = (constant(h["x"]) & ((first["x"] == h["x"]) | (first["y"] == h["x"]))) | (constant(h["y"]) & ((first["x"] == h["y"]) | (first["y"] == h["y"])))
    return F.coalesce((F.size(b) == 1) & (same | again), F.lit(False))


def shape(rule: Column) -> Column:
    """cyclic, u_c (a constant in the body), u_d (a dangling variable), zero, u_xxc or u_xxd (the same with a reflexive head); null without an arrow."""
    h, b = head(rule), body(rule)
    constant = lambda c: ~c.rlike("^[A-Z]$")
    last = F.element_at(b, -1)
    fixed = constant(last["x"]) | constant(last["y"])
    return (
        F.when(b.isNull(), F.lit(None).cast("string"))
        .when((F.size(b) == 1) & (F.split(rule, " <= ")[1] == ""), "zero")
        .when(h["x"] == h["y"], F.when(fixed, "u_xxc").otherwise("u_xxd"))
        .when(~constant(h["x"]) & ~constant(h["y"]), "cyclic")
        .when(fixed, "u_c")
        .otherwise("u_d")
    )


SHAPES = ("cyclic", "u_c", "u_d", "zero", "u_xxc", "u_xxd")


def is_active(rule: Column, num_true: Column, shapes: tuple[str, ...] = SHAPES, least_cyclic: int = 5, least_constant: int = 5, longest: int = 3) -> Column:
    """Whether a rule is to be applied: its shape is switched on, its support and the length of its body fit.

    ``least_cyclic`` and ``longest`` hold for cyclic rules, ``least_constant`` for rules with a constant in the head or a zero body.
    To be asked of the rule table, before anything is joined to it.
    """
    kind = shape(rule)
    fits = F.when(kind == "cyclic", (num_true >= least_cyclic) & (F.size(body(rule)) <= longest)).otherwise(num_true >= least_constant)
    return F.coalesce(kind.isin(*shapes) & fits, F.lit(False))
