"""Comparing two applied-rules tables, and choosing among rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import dealt

KEY = ["direction", "p", "q", "cand"]


def multiset_difference(left: str, right: str):
    """What the array ``left`` has beyond ``right``, repetitions counted, sorted."""
    many = lambda c, x: F.size(F.filter(c, lambda y: y == x))
    surplus = F.transform(F.array_distinct(left), lambda x: F.array_repeat(x, F.greatest(many(left, x) - many(right, x), F.lit(0))))
    return F.sort_array(F.flatten(surplus))


def differences(a: DataFrame, b: DataFrame, tasks: int | None = None) -> DataFrame:
    """Full outer comparison: ``status`` missing (only in a), extra (only in b), mismatch or same, with ``only_a`` and ``only_b``."""
    x = a.select(*KEY, F.col("rule_ids").alias("ra"), F.lit(1).alias("_a"))
    y = b.select(*KEY, F.col("rule_ids").alias("rb"), F.lit(1).alias("_b"))
    if tasks is not None:
        x, y = dealt(x, tasks, *KEY), dealt(y, tasks, *KEY)
    both = x.join(y, KEY, "full_outer")
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("ra") == F.col("rb"), "same").otherwise("mismatch")
    empty = F.expr("cast(array() as array<int>)")
    both = both.select(*KEY, status.alias("status"), F.coalesce("ra", empty).alias("ra"), F.coalesce("rb", empty).alias("rb"))
    only_a, only_b = multiset_difference("ra", "rb"), multiset_difference("rb", "ra")
    return both.select(*KEY, "status", only_a.alias("only_a"), only_b.alias("only_b"), ((F.col("status") == "mismatch") & (F.size(only_a) == 0) & (F.size(only_b) == 0)).alias("same_multiset"))


def query_key_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Queries that only one side has."""
    key = ["direction", "p", "q"]
    x, y = a.select(*key).distinct(), b.select(*key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("a")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("b")))


def common(a: DataFrame, b: DataFrame, rules_from: str = "a") -> DataFrame:
    """The keys of both tables with the rules of the chosen one."""
    keep, other = (a, b) if rules_from == "a" else (b, a)
    return keep.join(other.select(*KEY), KEY, "left_semi")


def entry_counts(a: DataFrame) -> DataFrame:
    """Entries by direction, by direction and relation, and by query."""
    return a.rollup("direction", "p", "q").agg(F.count("*").alias("n"), F.grouping_id().alias("level")).filter("direction is not null").select("direction", "p", "q", "n", F.col("level").cast("int").alias("level"))


def best_by(metrics: DataFrame, keys: list[str], score: str, choice: str, order: str) -> DataFrame:
    """The choice with the strictly best score of each key; the earliest of equals."""
    return metrics.groupBy(*keys).agg(F.max_by(choice, F.struct(F.col(score), -F.col(order))).alias(choice))


def with_fallback(relations: DataFrame, best: DataFrame, counts: DataFrame, keys: list[str], choice: str) -> DataFrame:
    """The best choice of each relation; relations without one take that of the most frequent relation."""
    top = counts.agg(F.max_by("p", F.struct("n", "p")).alias("p"))
    fallback = best.join(F.broadcast(top), "p").select(*[k for k in keys if k != "p"], F.col(choice).alias("_fallback"))  # one row a direction
    joined = relations.join(best, keys, "left").join(F.broadcast(fallback), [k for k in keys if k != "p"], "left")
    return joined.select(*keys, F.coalesce(choice, "_fallback").alias(choice), F.col(choice).isNull().alias("is_fallback"))


def mean_of_top(confs, n: int = 10):
    """The sum of the first n confidences divided by n, however many there are."""
    return F.aggregate(F.slice(confs, 1, n), F.lit(0.0), lambda s, x: s + x) / n


def counts_by_level(a: DataFrame) -> DataFrame:
    """``level, entries, keys``: for the levels direction, relation, query and candidate, the entries and the distinct keys."""
    levels = ("direction", "relation", "query", "candidate")
    rows = a.filter("direction is not null").groupBy(*KEY).agg(F.count("*").alias("n"), F.lit(1).cast("long").alias("_candidate"))
    for at in (3, 2, 1):  # each level from the one below, so that no row is copied for each level
        rows = rows.groupBy(*KEY[:at]).agg(F.sum("n").alias("n"), *[F.sum(f"_{x}").alias(f"_{x}") for x in levels[at:]], F.lit(1).cast("long").alias(f"_{levels[at - 1]}"))
    rows = rows.select(F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col("n").alias("n"), F.col(f"_{x}").alias("k")) for x in levels])).alias("x"))
    return rows.groupBy("x.level").agg(F.sum("x.n").alias("entries"), F.sum("x.k").alias("keys"))


def _both(a: DataFrame, b: DataFrame, keys: list[str], tasks: int | None) -> DataFrame:
    """``keys, in_a, in_b`` (0 or 1) of both tables' keys, which meet in ``tasks`` partitions."""
    sides = a.select(*keys, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select(*keys, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    return (sides if tasks is None else dealt(sides, tasks, *keys)).groupBy(*keys).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))


def _counts(of: DataFrame, what: str) -> DataFrame:
    number = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return of.agg(number("in_a").alias(f"{what}a"), number("in_b").alias(f"{what}b"), number(F.col("in_a") * F.col("in_b")).alias(f"{what}common"))


def summary(a: DataFrame, b: DataFrame, tasks: int | None = None) -> DataFrame:
    """``a, b, common``: how many keys each table has, and both."""
    return _counts(_both(a, b, KEY, tasks), "")


def first_of(rows: DataFrame, n: int, order: list) -> DataFrame:
    """The first ``n`` rows in an order, for display."""
    return rows.orderBy(*order).limit(n)


def sample_differences(a: DataFrame, b: DataFrame, at: str = "sample") -> DataFrame:
    """Samples of two datasets that are not the same: ``sample, what``, by position.

    Both: ``sample, rule_ids, gold``.  ``what`` is missing (only in a), extra (only in b), gold, length or rules,
    the first of these that differs; equal datasets give no row.  Rule lists are compared in their order, and nulls as values.
    """
    x = a.select(at, F.col("rule_ids").alias("ra"), F.col("gold").alias("ga"), F.lit(1).alias("_a"))
    y = b.select(at, F.col("rule_ids").alias("rb"), F.col("gold").alias("gb"), F.lit(1).alias("_b"))
    what = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(~F.col("ga").eqNullSafe(F.col("gb")), "gold").when(~F.size("ra").eqNullSafe(F.size("rb")), "length").when(~F.col("ra").eqNullSafe(F.col("rb")), "rules")
    return x.join(y, at, "full_outer").select(at, what.alias("what")).filter("what is not null")


def report(a: DataFrame, b: DataFrame, tasks: int | None = None) -> DataFrame:
    """``section, direction, p, q, cand, only_a, only_b, same_multiset``: all that differs between two applied-rules tables, a row each.

    Sections: missing_query, extra_query, missing, extra, rules.
    """
    rules = F.expr("cast(null as array<int>)")
    queries = query_key_differences(a, b).select(F.when(F.col("side") == "a", "missing_query").otherwise("extra_query").alias("section"), "direction", "p", "q", F.lit(None).cast(dict(a.dtypes)["cand"]).alias("cand"), rules.alias("only_a"), rules.alias("only_b"), F.lit(None).cast("boolean").alias("same_multiset"))
    keys = differences(a, b, tasks).filter("status <> 'same'").select(F.when(F.col("status") == "mismatch", "rules").otherwise(F.col("status")).alias("section"), *KEY, "only_a", "only_b", "same_multiset")
    return queries.unionByName(keys)


def report_counts(a: DataFrame, b: DataFrame, tasks: int | None = None) -> DataFrame:
    """``target_keys_a, target_keys_b, query_keys_a, query_keys_b, query_keys_both, covers_a``: the head of a comparison report."""
    keys = summary(a, b, tasks)
    both = _counts(_both(a, b, ["direction", "p", "q"], tasks), "query_keys_").withColumnRenamed("query_keys_common", "query_keys_both")
    return keys.crossJoin(both).select(F.col("a").alias("target_keys_a"), F.col("b").alias("target_keys_b"), "query_keys_a", "query_keys_b", "query_keys_both", (F.col("common") == F.col("a")).alias("covers_a"))  # one row each
