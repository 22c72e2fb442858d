"""Applying rules to a graph as equi-joins, with the rules as rows.

There is one join template for each shape of rule, never one for each rule.  A
rule fires once for a query and candidate, however many groundings it has.
Queries, where given, restrict the bound side before the last join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import saved
from .skew import hub_join

#: Rule tables of at most so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_RULES = 100_000
#: A key of a step with more pairs of rows than this is dealt over several tasks.
MOST_PAIRS = 2_000_000
#: Readings of relations of which at most so many become a filter of the scans.
MAX_READINGS = 10_000


def few(rules: DataFrame) -> DataFrame:
    """``rules``, broadcast if they are at most ``BROADCAST_RULES``."""
    return F.broadcast(rules) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rules


def _named(rules: DataFrame, length: int | None = None) -> list | None:
    """The readings ``step, rel, inv`` that the rules name, in one job; None if they are more than ``MAX_READINGS``."""
    columns = [("rel", "inv")] if length is None else [(f"rel{n}", f"inv{n}") for n in range(1, length + 1)]
    steps = F.array(*[F.struct(F.lit(n).alias("step"), F.col(rel).alias("rel"), F.col(inv).alias("inv")) for n, (rel, inv) in enumerate(columns, 1)])
    found = rules.select(F.explode(steps).alias("s")).select("s.*").distinct().limit(MAX_READINGS + 1).collect()
    return found if len(found) <= MAX_READINGS else None


def _edges(triples: DataFrame, named: list | None, step: int = 1) -> DataFrame:
    """The readings ``rel, inv, a, b`` of the triples that the rules ask for in a step.

    The relations that the rules name, a few, become a constant filter, which reaches the
    scans and drops those of all other relations before any shuffle.
    """
    out = None
    for turned, a, b in ((False, "s", "o"), (True, "o", "s")):
        relations = None if named is None else sorted({r.rel for r in named if r.step == step and r.inv == turned and r.rel is not None})
        part = triples if relations is None else triples.filter(F.col("p").isin(relations))
        if relations is None or relations or turned and out is None:
            part = part.select(F.col("p").alias("rel"), F.lit(turned).alias("inv"), F.col(a).alias("a"), F.col(b).alias("b"))
            out = part if out is None else out.unionByName(part)
    return out


def cyclic(rules: DataFrame, triples: DataFrame, length: int, queries: DataFrame | None = None) -> DataFrame:
    """``rule_id, x, y`` of rules ``h(X,Y) <= r1(X,A), ..., rn(B,Y)``.

    ``rules``: ``rule_id, rel1, inv1, ..., reln, invn``; ``inv`` says that an atom is
    written from right to left.  ``queries``: the values ``x`` to start from.
    """
    out, named = None, _named(rules, length)
    for n in range(1, length + 1):
        edges = _edges(triples, named, n)
        step = edges.select(F.col("rel").alias(f"rel{n}"), F.col("inv").alias(f"inv{n}"), F.col("a").alias("x" if n == 1 else "_at"), F.col("b").alias("_to"))
        if n == 1:
            step = step if queries is None else step.join(queries.select("x").distinct(), "x", "left_semi")
            out = step.join(few(rules), ["rel1", "inv1"])
        else:
            before = saved(out.withColumnRenamed("_to", "_at").distinct(), f"step{n - 1}")
            if n == length:  # entities with one way on reach nothing twice
                many = saved(before.groupBy("rule_id", "x").agg(F.count("*").alias("n")).filter("n > 1").select("rule_id", "x"), "several")
                once = many.isEmpty()
            out = hub_join(before, saved(step.distinct(), f"edges{n}"), [f"rel{n}", f"inv{n}", "_at"], most_pairs=MOST_PAIRS)
        out = out.select("rule_id", *[c for m in range(n + 1, length + 1) for c in (f"rel{m}", f"inv{m}")], "x", "_to")
    found = out.select("rule_id", "x", F.col("_to").alias("y"))
    return found if length > 1 and once else found.distinct()


def with_constant(rules: DataFrame, triples: DataFrame) -> DataFrame:
    """``rule_id, x, y`` of rules ``h(X,c) <= b(X,d)``; ``rules``: ``rule_id, rel, inv, const, answer``."""
    return _edges(triples, _named(rules)).withColumnRenamed("b", "const").join(few(rules), ["rel", "inv", "const"]).select("rule_id", F.col("a").alias("x"), F.col("answer").alias("y")).distinct()


def dangling(rules: DataFrame, triples: DataFrame) -> DataFrame:
    """``rule_id, x, y`` of rules ``h(X,c) <= b(X,A)``; ``rules``: ``rule_id, rel, inv, answer``."""
    return _edges(triples, _named(rules)).select("rel", "inv", "a").join(few(rules), ["rel", "inv"]).select("rule_id", F.col("a").alias("x"), F.col("answer").alias("y")).distinct()


def zero(rules: DataFrame, queries: DataFrame) -> DataFrame:
    """``rule_id, x, y`` of rules ``h(X,c) <=`` for the given queries ``p, x``; ``rules``: ``rule_id, head_rel, answer``."""
    return queries.withColumnRenamed("p", "head_rel").join(few(rules), "head_rel").select("rule_id", "x", F.col("answer").alias("y")).distinct()


def reflexive(rules: DataFrame, triples: DataFrame) -> DataFrame:
    """``rule_id, x, y`` of rules ``h(X,X) <= b(X,d)``: the candidate is the query itself."""
    return _edges(triples, _named(rules)).withColumnRenamed("b", "const").join(few(rules), ["rel", "inv", "const"]).select("rule_id", F.col("a").alias("x"), F.col("a").alias("y")).distinct()


def reflexive_dangling(rules: DataFrame, triples: DataFrame) -> DataFrame:
    """``rule_id, x, y`` of rules ``h(X,X) <= b(X,A)``; ``rules``: ``rule_id, rel, inv``."""
    return _edges(triples, _named(rules)).join(few(rules), ["rel", "inv"]).select("rule_id", F.col("a").alias("x"), F.col("a").alias("y")).distinct()


def support(fired: DataFrame, known: DataFrame) -> DataFrame:
    """``rule_id, num_preds, num_true`` of fired rules ``rule_id, p, x, y`` against known triples."""
    true = known.select("p", F.col("s").alias("x"), F.col("o").alias("y"), F.lit(1).alias("hit")).distinct()
    return fired.join(true, ["p", "x", "y"], "left").groupBy("rule_id").agg(F.count("*").alias("num_preds"), F.count("hit").alias("num_true"))


def maxplus_topk(fired: DataFrame, keys: list[str], k: int, tie: str = "cand") -> DataFrame:
    """The first k candidates of each query by their confidences, largest first, compared in turn; then by ``tie``.

    ``fired``: keys, ``cand, rule_id, conf``.  Adds ``confs``, ``rule_ids`` (in
    the order of the confidences) and ``pos`` from 1.
    """
    by = fired.groupBy(*keys, "cand").agg(F.sort_array(F.collect_list(F.struct("conf", (-F.col("rule_id")).alias("r"))), asc=False).alias("f"))
    return first_by_confidence(by, keys, k, tie)


def first_by_confidence(by: DataFrame, keys: list[str], k: int, tie: str = "cand") -> DataFrame:
    """:func:`maxplus_topk` of candidates with their rules: keys, ``cand`` and ``f``, an array of confidences ``conf`` and negated ids ``r``, largest first."""
    by = by.select(*keys, "cand", F.col("f.conf").alias("confs"), F.transform("f.r", lambda r: -r).alias("rule_ids"))
    return by.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confs"), tie))).filter(F.col("pos") <= k)


def capped(applied: DataFrame, n: int, column: str = "rule_ids") -> DataFrame:
    """At most n rules for each candidate; all if n is not positive."""
    return applied.withColumn(column, F.slice(column, 1, n)) if n > 0 else applied


def in_topk(applied: DataFrame, ranking: DataFrame, keys: list[str]) -> DataFrame:
    """The applied rows whose candidate is in the ranking."""
    return applied.join(ranking.select(*keys, "cand"), [*keys, "cand"], "left_semi")


def unknown_only(candidates: DataFrame, known: DataFrame, keys: list[str], target: str | None = None) -> DataFrame:
    """Drop candidates that known triples answer; the column ``target`` names an answer that stays."""
    gone = known.select(*keys, F.col("a").alias("cand")).distinct()
    if target is None:
        return candidates.join(gone, [*keys, "cand"], "left_anti")
    others = candidates.filter(~F.col("cand").eqNullSafe(F.col(target))).join(gone, [*keys, "cand"], "left_anti")
    return others.unionByName(candidates.filter(F.col("cand").eqNullSafe(F.col(target))).select(*others.columns))


def reflexive_named(applied: DataFrame, q: str = "q", cand: str = "cand", name: str = "me_myself_i") -> DataFrame:
    """The placeholder for the query's own entity replaced by it, its rules kept."""
    return applied.withColumn(cand, F.when(F.col(cand) == name, F.col(q)).otherwise(F.col(cand)))


def positive_ids(applied: DataFrame, column: str = "rule_ids") -> DataFrame:
    """Rule ids of 0 and less removed; the row stays even when none is left."""
    return applied.withColumn(column, F.filter(column, lambda x: x > 0))


def first_unknown(scored: DataFrame, known: DataFrame, keys: list[str], k: int = 100, before: int = 3000, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The first ``k`` candidates by score that no known triple answers, of the first ``before`` of all, and keys with fewer.

    ``scored``: keys, ``cand, score``; ties go by ``cand``.  Returns keys, ``cand, score, pos`` from 1, and keys, ``n``.
    """
    best = lambda: Window.partitionBy(*keys).orderBy(F.desc("score"), "cand")
    first = scored.withColumn("_n", F.row_number().over(best())).filter(F.col("_n") <= before).drop("_n")
    top = unknown_only(first, known, keys, target).withColumn("pos", F.row_number().over(best())).filter(F.col("pos") <= k).select(*keys, "cand", "score", "pos")
    many = scored.select(*keys).distinct().join(top.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))
    return top, many.filter(F.col("n") < k)
