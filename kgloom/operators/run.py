"""One run over all relations: from training samples to the metrics of the test split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..store import saved
from . import fit, samples, score
from .skew import dealt, tasks_of

KEYS = ["direction", "p", "q"]
METRICS = ["mrr", "h1", "h10"]
#: The same keys, the finest first, as sorts compare it first.
_BY = ["q", "p", "direction"]


@dataclass
class Split:
    """``applied``: ``direction, p, q, cand, rule_ids``, each candidate of a query once; ``golds``: ``direction, p, q, gold``; ``filtered``, if given: keys and ``cand`` that count with score 0."""

    applied: DataFrame
    golds: DataFrame
    filtered: DataFrame | None = None


@dataclass
class Run:
    """``fitted``; ``by_direction``: ``p, direction, n`` and metrics; ``by_relation``: ``p`` and metrics, the means of both directions; ``overall``: one row ``relations, n`` and metrics weighted by test triples; ``failed``: ``p, error``."""

    fitted: fit.Fitted
    by_direction: DataFrame
    by_relation: DataFrame
    overall: DataFrame
    failed: DataFrame


def scored(applied: DataFrame, weights: DataFrame, biases: DataFrame, model: str = "linear", constrained: bool = True, pairs: DataFrame | None = None) -> DataFrame:
    """``direction, p, q, cand, score`` of candidates under fitted weights (``p, rule_id, trained``; pairs ``p, a, b, trained``) and ``p, bias, gamma``.

    Rules that a relation does not have count nothing; candidates of relations without a fit have score 0.
    """
    keys = [*KEYS, "cand"]
    sums = score.value_sums(applied, weights, "trained", keys).withColumnRenamed("score", "_sum")
    if pairs is not None:
        both = samples.pairs_in(applied.select(*keys, "rule_ids"), pairs.select("p", "a", "b", "trained")).groupBy(*keys).agg(F.sum("trained").alias("_pairs"))
        sums = sums.join(both, keys, "left")
    else:
        sums = sums.withColumn("_pairs", F.lit(0.0))
    z = F.col("_sum") + F.col("gamma") * F.coalesce("_pairs", F.lit(0.0))
    return sums.join(biases.select("p", "bias", "gamma"), "p", "left").select(*keys, _value(z, model, constrained).alias("score"))


def _value(z: Column, model: str, constrained: bool) -> Column:
    """The score of the summed weights ``z``; 0 without a ``bias``."""
    if model == "linear":
        value = scores.sigmoid(z + F.col("bias"))
    else:
        value = 1 - F.exp(-(z + F.col("bias") * F.col("bias") if constrained else scores.softplus(z + F.col("bias"))))
    return F.coalesce(value, F.lit(0.0))


def asked(split: Split) -> DataFrame:
    """What every evaluation of a split reads: ``q, p, direction, cand, rule_ids, golds, is_cand, counts``.

    A row for each candidate of a query that has golds, and for each gold that is no candidate.  ``golds``: how often it is
    listed as gold; ``counts``: it is a candidate and neither gold nor filtered.  All meet once, by query.
    """
    kind = dict(split.applied.dtypes)["rule_ids"]

    def tagged(df: DataFrame, cand: str, what: int, n: Column, ids: Column) -> DataFrame:
        return df.select(*_BY, F.col(cand).alias("cand"), F.lit(what).alias("what"), n.alias("n"), ids.alias("rule_ids"))

    none = F.lit(None).cast(kind)
    rows = tagged(split.applied.dropna(subset=_BY), "cand", 0, F.lit(0).cast("long"), F.col("rule_ids"))
    rows = rows.unionByName(tagged(split.golds.groupBy(*_BY, "gold").agg(F.count("*").alias("n")), "gold", 1, F.col("n"), none))
    if split.filtered is not None:
        rows = rows.unionByName(tagged(split.filtered.dropna(subset=[*_BY, "cand"]), "cand", 2, F.lit(0).cast("long"), none))
    of_query = Window.partitionBy(*_BY).orderBy("cand")
    same, all_of = of_query.rangeBetween(Window.currentRow, Window.currentRow), of_query.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = F.col("cand").isNotNull()
    rows = rows.withColumns({"_golds": F.sum("n").over(same), "_cands": F.max((F.col("what") == 0) & known).over(same), "_filtered": F.max(F.col("what") == 2).over(same), "_asked": F.max(F.col("what") == 1).over(all_of)})
    is_cand = F.col("what") == 0
    rows = rows.filter("_asked and (what = 0 or what = 1 and not _cands)")
    golds = F.when(is_cand & ~known, 0).when(is_cand, F.col("_golds")).otherwise(F.col("n"))
    return rows.select(*_BY, "cand", "rule_ids", golds.alias("golds"), is_cand.alias("is_cand"), (is_cand & (golds == 0) & (~known | ~F.col("_filtered"))).alias("counts"))


def metrics_of(rows: DataFrame, weights: DataFrame, biases: DataFrame, entities: int, model: str = "linear", constrained: bool = True) -> DataFrame:
    """``p, direction, n, mrr, h1, h10`` under fitted weights, from the saved rows of :func:`asked`; ranks are those of :func:`kgloom.operators.score.ranks`.

    Rows are dealt by query once; scores, levels and ranks need no other shuffle (but the weights' own, if they are not broadcast).
    """
    columns = [*_BY, "cand", "golds", "is_cand", "counts"]
    fired = dealt(rows, tasks_of(rows), *_BY).select(*columns, F.explode_outer("rule_ids").alias("rule_id"))
    sums = fired.join(weights.select("p", "rule_id", "trained"), ["p", "rule_id"], "left").groupBy(*columns).agg(F.coalesce(F.sum("trained"), F.lit(0.0)).alias("_sum"))
    scored = sums.join(biases.select("p", "bias"), "p", "left").withColumn("s", F.when(F.col("is_cand"), F.round(_value(F.col("_sum"), model, constrained), score.DIGITS)))
    return score.metrics(score.ranks_of_marked(scored, _BY, entities), ["p", "direction"], "golds")


def metrics(split: Split, weights: DataFrame, biases: DataFrame, entities: int, model: str = "linear", constrained: bool = True, pairs: DataFrame | None = None) -> DataFrame:
    """``p, direction, n, mrr, h1, h10`` of a split's golds under fitted weights."""
    if pairs is None:
        return metrics_of(saved(asked(split), "asked"), weights, biases, entities, model, constrained)
    ranked = score.ranks(scored(split.applied, weights, biases, model, constrained, pairs), split.golds, entities, KEYS, split.filtered)
    return score.metrics(ranked, ["p", "direction"])


def completion(train: DataFrame, rules: DataFrame, valid: Split, test: Split, entities: int, model: str = "linear", every: int = 5, patience: int = 0, **options) -> Run:
    """Fit each relation on ``train`` (``p, rule_ids, gold``), keep its best epoch on ``valid``, and rank ``test`` with it.

    ``options`` are those of :class:`kgloom.operators.fit.Setting`.  Relations with test golds that have no fit are listed
    as failed, and their golds count in no mean.
    """
    constrained = options.get("constrained", True)
    on_valid = saved(asked(valid), "asked")

    def evaluate(weights: DataFrame, biases: DataFrame) -> DataFrame:
        return metrics_of(on_valid, weights, biases, entities, model, constrained)

    fitted = fit.train(train, rules, model, evaluate=evaluate, every=every, patience=patience, **options)
    by_direction = saved(metrics(test, fitted.rules, fitted.relations, entities, model, constrained), "metrics")
    failed = fit.failed(fitted, test.golds.select("p"))
    known = by_direction.join(failed, "p", "left_anti")
    by_relation = known.groupBy("p").agg(F.sum("n").alias("n"), *[(F.sum(c) / 2).alias(c) for c in METRICS])
    weighted = score.weighted(by_relation.drop("n"), by_relation.select("p", "n"), METRICS)
    overall = by_relation.agg(F.count("*").alias("relations"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).crossJoin(weighted)  # one row each
    return Run(fitted, by_direction, by_relation.drop("n"), overall, failed)
