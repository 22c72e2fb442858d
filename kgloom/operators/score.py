"""Scores of candidates, filtered tie-aware ranks, and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Scores are compared after rounding, as sums depend on their order.
DIGITS = 9


def with_value(samples: DataFrame, values: DataFrame, value: str, what: str = "rule_ids") -> DataFrame:
    """``samples`` exploded to one row a fired rule with its ``value``; ids that the relation does not have drop out.

    ``values``: ``p, rule_id`` and ``value`` (a confidence, a weight).  Rule tables are small beside
    samples, so Spark broadcasts them below its threshold and shuffles on ``(p, rule_id)`` above.
    """
    fired = samples.withColumn("rule_id", F.explode(what))
    return fired.join(values.select("p", "rule_id", value), ["p", "rule_id"])


def value_sums(samples: DataFrame, values: DataFrame, value: str, keys: list[str], what: str = "rule_ids") -> DataFrame:
    """``keys, score``: the summed values of each sample's rules, 0 for a sample without a rule of its relation."""
    sums = with_value(samples.select(*keys, what), values, value, what).groupBy(*keys).agg(F.sum(value).alias("score"))
    return samples.select(*keys).join(sums, keys, "left").select(*keys, F.coalesce("score", F.lit(0.0)).alias("score"))


def accuracy(predicted: DataFrame, positive_weight: float = 5.0) -> DataFrame:
    """``accuracy`` of ``pred > 0.5`` against ``gold``, and ``mean_loss`` as of :func:`losses`."""
    right = predicted.agg(F.avg(((F.col("pred") > 0.5).cast("int") == F.col("gold")).cast("double")).alias("accuracy"))
    return right.crossJoin(losses(predicted, positive_weight).select("mean_loss"))  # one row each


def best_checkpoint(evaluated: DataFrame, keys: list[str], metric: str = "mrr") -> DataFrame:
    """``keys, epoch, metric`` of the evaluation with the largest metric above -1, the earliest of equals.

    ``evaluated``: keys, ``epoch`` and the metric.
    """
    best = evaluated.filter(F.col(metric) > -1).groupBy(*keys).agg(F.max(F.struct(F.col(metric), (-F.col("epoch")).alias("at"))).alias("b"))
    return best.select(*keys, (-F.col("b.at")).alias("epoch"), F.col(f"b.{metric}").alias(metric))


def stopping_epoch(evaluated: DataFrame, patience: int, metric: str = "mrr_raw") -> DataFrame:
    """``p, epoch``: where early stopping ends, null if it never does.

    ``evaluated``: ``p, direction, epoch`` and the metric.  Training stops after ``patience`` evaluations
    in a row in which the mean over the directions of the best metric so far did not rise.
    """
    so_far = Window.partitionBy("p", "direction").orderBy("epoch")
    best = evaluated.withColumn("_best", F.greatest(F.max(metric).over(so_far), F.lit(-1.0)))
    mean = best.groupBy("p", "epoch").agg((F.sum("_best") / 2).alias("mean"))
    by_epoch = Window.partitionBy("p").orderBy("epoch")
    rise = mean.withColumn("rise", F.col("mean") > F.coalesce(F.lag("mean").over(by_epoch), F.lit(-1.0)))
    runs = rise.withColumns({"run": F.sum(F.col("rise").cast("int")).over(by_epoch), "n": F.row_number().over(by_epoch)})
    waited = runs.withColumn("waited", F.col("n") - F.max(F.when(F.col("rise"), F.col("n")).otherwise(0)).over(by_epoch))
    ended = F.min(F.when(F.col("waited") >= patience, F.col("epoch")))
    return waited.groupBy("p").agg((ended if patience > 0 else F.lit(None).cast("int")).alias("epoch"))


def time_rollup(reports: DataFrame, columns: list[str]) -> DataFrame:
    """The sums of the time fields of all relations, null as 0, and their number."""
    return reports.agg(F.count("*").alias("relations"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns])


def ranks(scored: DataFrame, golds: DataFrame, entities: int, keys: list[str], filtered: DataFrame | None = None) -> DataFrame:
    """Filtered mean ranks: ``keys, gold, rank`` and ``n_cands``.

    ``scored``: keys, ``cand, score``; ``golds``: keys, ``gold``; ``filtered``: keys,
    ``cand`` that count with score 0.  With C the candidates of a positive score
    that are neither gold nor filtered: a gold of score s > 0 has rank #(C > s) +
    (#(C = s) + 2) / 2, any other |C| + (entities - |C| + 1) / 2.  A key without
    candidates has a null rank.  Each candidate is marked once as gold or filtered, counted by
    score level, and the levels are summed up from the best one down.
    """
    mark = lambda df, cand, name: df.select(*keys, F.col(cand).alias("cand"), F.lit(True).alias(name)).distinct()
    rows = scored.select(*keys, "cand", F.round("score", DIGITS).alias("s")).join(mark(golds, "gold", "_gold"), [*keys, "cand"], "left")
    counts = (F.col("s") > 0) & F.col("_gold").isNull()
    if filtered is not None:
        rows = rows.join(mark(filtered, "cand", "_filtered"), [*keys, "cand"], "left")
        counts = counts & F.col("_filtered").isNull()
    levels = rows.groupBy(*keys, "s").agg(F.count(F.when(counts, 1)).alias("same"))
    of_key = Window.partitionBy(*keys)
    levels = levels.select(*keys, "s", "same", F.coalesce(F.sum("same").over(of_key.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("more"), F.sum("same").over(of_key).alias("_all"), F.row_number().over(of_key.orderBy(F.desc("s"))).alias("_n"))
    # a gold's own level, if it is a candidate, else a level -1 that each key's first one brings along for the number of candidates
    level = lambda s, same, more: F.struct(s.alias("s"), same.alias("same"), more.alias("more"))
    one, nil = level(F.col("s"), F.col("same"), F.col("more")), level(F.lit(-1.0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    levels = levels.select(*keys, F.col("_all").alias("n_cands"), F.explode(F.when(F.col("_n") == 1, F.array(one, nil)).otherwise(F.array(one))).alias("_l")).select(*keys, "n_cands", "_l.*")
    own = golds.join(rows.filter("_gold and s > 0").select(*keys, F.col("cand").alias("gold"), "s"), [*keys, "gold"], "left").withColumn("s", F.coalesce("s", F.lit(-1.0)))
    own = own.join(levels, [*keys, "s"], "left")
    rank = F.when(F.col("s") > 0, F.col("more") + (F.col("same") + 2) / 2).otherwise(F.col("n_cands") + (F.lit(entities) - F.col("n_cands") + 1) / 2)
    return own.select(*keys, "gold", F.coalesce("n_cands", F.lit(0)).alias("n_cands"), rank.alias("rank"))


def ranks_of_marked(rows: DataFrame, keys: list[str], entities: int) -> DataFrame:
    """``keys, rank, golds`` of golds: the ranks of :func:`ranks`, with no shuffle where ``rows`` are dealt by their first key.

    ``rows``: keys, the rounded score ``s`` (null if no candidate), ``golds`` (how often it is a gold), ``is_cand``, and ``counts``: it is a
    candidate and neither gold nor filtered.
    """
    level = F.when(F.col("s") > 0, F.col("s"))  # null: golds that are no candidates, or of score 0
    levels = rows.groupBy(*keys, level.alias("s")).agg(F.count(F.when(F.col("counts") & (F.col("s") > 0), 1)).alias("same"), F.sum("golds").alias("golds"), F.max("is_cand").alias("is_cand"))
    of_query = Window.partitionBy(*keys).orderBy(F.desc("s"))
    whole = of_query.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    more = F.coalesce(F.sum("same").over(of_query.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = levels.withColumns({"more": more, "all": F.sum("same").over(whole), "any": F.max("is_cand").over(whole)}).filter("golds > 0")
    rank = F.when(F.col("s").isNotNull(), F.col("more") + (F.col("same") + 2) / 2).when(F.col("any"), F.col("all") + (F.lit(entities) - F.col("all") + 1) / 2)
    return levels.select(*keys, rank.alias("rank"), "golds")


def metrics(ranked: DataFrame, by: list[str], times: str | None = None) -> DataFrame:
    """``n, mrr, h1, h10``; golds without a rank count in n and score nothing.  A row stands for as many golds as its column ``times`` says, or for one."""
    n = F.col(times) if times else F.lit(1).cast("long")
    hit = lambda at: F.sum(F.when(at, n).otherwise(0)) / F.sum(n)
    return ranked.groupBy(*by).agg(F.sum(n).alias("n"), (F.coalesce(F.sum(n / F.col("rank")), F.lit(0.0)) / F.sum(n)).alias("mrr"), hit(F.col("rank") == 1).alias("h1"), hit(F.col("rank") <= 10).alias("h10"))


def head_tail_mean(by_direction: DataFrame, relations: DataFrame, value: str = "mrr") -> DataFrame:
    """``p, value``: the mean of both directions; 0 for a relation without test triples."""
    mean = by_direction.groupBy("p").agg((F.sum(value) / 2).alias("m"))
    return relations.join(mean, "p", "left").select("p", F.coalesce("m", F.lit(0.0)).alias(value))


def weighted(values: DataFrame, counts: DataFrame, columns: list[str]) -> DataFrame:
    """Means of the columns over relations, weighted by their test counts."""
    joined = values.join(counts.filter("n > 0"), "p")
    return joined.agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in columns])


def losses(predicted: DataFrame, positive_weight: float = 5.0) -> DataFrame:
    """Weighted cross entropy of ``pred, gold``: its mean, its sum and the mean of the means of both classes."""
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("pred")))
    entry = -(F.col("gold") * F.log(p) * positive_weight + (1 - F.col("gold")) * F.log(1 - p))
    return predicted.select("gold", entry.alias("l")).agg(F.avg("l").alias("mean_loss"), F.sum("l").alias("sum_loss"), ((F.avg(F.when(F.col("gold") == 1, F.col("l"))) + F.avg(F.when(F.col("gold") == 0, F.col("l")))) / 2).alias("class_mean_loss"))


#: Vectors of a block on either side of the product.
BLOCK = 4_096


def dot_topk(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``q, cand, pos, score``: the k candidates of the largest dot product for each query, of any number; ties go by ``cand``.

    Both sides are dealt into blocks of about ``block`` vectors.  Each pair of blocks is one matrix product in one
    task, which keeps the first k of each query; only these meet, so no row for a pair of vectors
    exists.  Null vectors match nothing, others those of their length; NaN is the largest score, as in SQL.
    """
    import numpy as np
    import pyarrow as pa

    kind = dict(queries.dtypes)[key]
    many = [max(1, -(-df.count() // block)) for df in (queries, vectors)]

    def dealt(df: DataFrame, own: int, name: str, other: int, other_name: str) -> DataFrame:
        rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"))
        return rows.withColumn("_d", F.size("v")).withColumns({name: F.pmod(F.xxhash64("k"), F.lit(own)).cast("int"), other_name: F.explode(F.sequence(F.lit(0), F.lit(other - 1)))})

    def matrix(group):
        v = group.column("v").combine_chunks()
        return group.column("k").combine_chunks(), v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1 if len(v.flatten()) else 0)

    def product(left, right):
        (q, a), (c, b) = matrix(left), matrix(right)
        names = ["q", "cand", "score"]
        if not len(q) or not len(c):
            return pa.table([q.slice(0, 0), c.slice(0, 0), pa.array([], pa.float64())], names=names)
        order = np.argsort(c.to_numpy(zero_copy_only=False), kind="stable")
        b, rows, columns, scores = b[order], [], [], []
        for begin in range(0, len(q), 512):
            dots = np.round(a[begin : begin + 512] @ b.T, 6)
            least = np.partition(dots, -k, axis=1)[:, -k, None] if k < dots.shape[1] else -np.inf
            row, at = np.nonzero(~(dots < least))  # the first k and all that tie with the last of them, by row and then by candidate
            score = dots[row, at]
            best = np.lexsort((-np.where(np.isnan(score), np.inf, score), row))
            row = row[best]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            rows.append(begin + row[kept])
            columns.append(order[at[best][kept]])
            scores.append(score[best][kept])
        return pa.table([q.take(pa.array(np.concatenate(rows))), c.take(pa.array(np.concatenate(columns))), pa.array(np.concatenate(scores))], names=names)

    one, two = dealt(queries, many[0], "_a", many[1], "_b"), dealt(vectors, many[1], "_b", many[0], "_a")
    partial = one.groupBy("_a", "_b", "_d").cogroup(two.groupBy("_a", "_b", "_d")).applyInArrow(product, f"q {kind}, cand {dict(vectors.dtypes)[key]}, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cand"))
    return partial.withColumn("pos", place).filter(F.col("pos") <= k).select("q", "cand", F.col("pos").cast("long").alias("pos"), "score")
