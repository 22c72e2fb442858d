"""Training samples from applied rules, and what rules hit in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import saved


def labelled(applied: DataFrame, answers: DataFrame) -> DataFrame:
    """Samples ``p, direction, q, cand, rule_ids, gold`` of the queries that have answers; empty rule lists are dropped.

    ``applied``: ``direction, p, q, cand, rule_ids``; ``answers``: ``direction, p, q, a``.  Both meet once, by query, where a
    candidate's answers are its neighbours in the order of candidates.
    """
    keys, kinds = ["q", "p", "direction"], dict(applied.dtypes)  # the finest first, as sorts compare it first
    asked = applied.filter(F.size("rule_ids") > 0).select(*keys, "cand", "rule_ids", F.lit(0).alias("hit"))
    rows = asked.unionByName(answers.select(*keys, F.col("a").alias("cand"), F.lit(None).cast(kinds["rule_ids"]).alias("rule_ids"), F.lit(1).alias("hit"))).dropna(subset=keys)
    of_query = Window.partitionBy(*keys).orderBy("cand")
    same, all_of = of_query.rangeBetween(Window.currentRow, Window.currentRow), of_query.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gold = F.when(F.col("cand").isNotNull(), F.col("_same")).otherwise(0)
    rows = rows.withColumns({"_same": F.max("hit").over(same), "_asked": F.max("hit").over(all_of)}).filter("hit = 0 and _asked = 1")
    return rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in ("p", "direction", "q", "cand")], "rule_ids", gold.alias("gold"))


def hit_counts(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """``p, rule_id, train_hit_count``: positive samples in which a rule of the relation fired, once a sample."""
    fired = samples.filter("gold = 1").select("p", F.explode(F.array_distinct("rule_ids")).alias("rule_id"))
    return fired.join(rules.select("p", "rule_id"), ["p", "rule_id"], "left_semi").groupBy("p", "rule_id").agg(F.count("*").alias("train_hit_count"))


def pairs_in(samples: DataFrame, synergy: DataFrame) -> DataFrame:
    """The known rule pairs ``a, b`` (a <= b) of which a sample has both, one row a sample and pair.

    Samples join the pairs by their first rule and look the second up in their own list.
    """
    first = samples.withColumn("a", F.explode(F.array_distinct("rule_ids")))
    return first.join(synergy, ["p", "a"]).filter(F.array_contains("rule_ids", F.col("b")))


#: Samples of a block of the bitmap index, as the engine's bitmaps have them.
INDEX_BLOCK = 32_768


def bitmap_index(samples: DataFrame) -> DataFrame:
    """``p, rule_id, block, bits``: in which samples of a block each rule fired; a row is 4 KB, whatever the rule's samples.

    Positive samples are numbered once, when they are written, by partition: blocks of a partition are filled one after the other.
    """
    place = F.monotonically_increasing_id()
    kept = saved(samples.filter("gold = 1").select("p", F.array_distinct("rule_ids").alias("rule_ids")).withColumn("n", place), "samples")
    fired = kept.select("p", F.floor(F.col("n") / INDEX_BLOCK).alias("block"), F.pmod("n", F.lit(INDEX_BLOCK)).alias("at"), F.explode("rule_ids").alias("rule_id"))
    return fired.groupBy("p", "rule_id", "block").agg(F.bitmap_construct_agg("at").alias("bits"))


def pair_hit_counts(samples: DataFrame, synergy: DataFrame) -> DataFrame:
    """``p, a, b, train_hit_count``: the positive samples in which both rules of a known pair fired; pairs without any have no row.

    A bitmap index of the samples by rule is made once.  A pair's count is, block by block, the bit count of
    the AND of its two rows; no sample is expanded into its pairs, and a rule that fires in most
    samples has a row a block.
    """
    index = saved(bitmap_index(samples), "index")
    pairs = synergy.select("p", "a", "b").distinct()
    sides = [pairs.join(index.withColumnRenamed("rule_id", x), ["p", x]).select("p", "a", "b", "block", "bits") for x in "ab"]
    both = sides[0].unionByName(sides[1]).groupBy("p", "a", "b", "block").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"), F.count("*").alias("sides"))
    found = both.filter("sides = 2").groupBy("p", "a", "b").agg(F.sum("n").alias("train_hit_count"))
    return found.filter("train_hit_count > 0")


def synergy_pairs(lines: DataFrame, rules: DataFrame, least_lift: float = 0.01, least_support: int = 5) -> DataFrame:
    """``p, a, b, lift`` from ``line, support, lift, rule1, rule2``.

    Pairs of known rules of one relation with enough support and lift; of a pair
    that is listed again, in either order, the first line counts.
    """
    good = lines.filter((F.col("support") >= least_support) & (F.col("lift") >= least_lift))
    one = rules.select(F.col("rule_id").alias("rule1"), F.col("p").alias("p"))
    two = rules.select(F.col("rule_id").alias("rule2"), F.col("p").alias("p2"))
    both = good.join(one, "rule1").join(two, "rule2").filter("p = p2").select("p", F.least("rule1", "rule2").alias("a"), F.greatest("rule1", "rule2").alias("b"), "line", "lift")
    return both.withColumn("rn", F.row_number().over(Window.partitionBy("p", "a", "b").orderBy("line"))).filter("rn = 1").select("p", "a", "b", "lift")


def degree_normalised(pairs: DataFrame, alpha: float) -> DataFrame:
    """``p, a, b, lift`` with the lift divided by ``(da * db) ** alpha``, a rule's degree being the pairs of its relation that it is in."""
    ends = pairs.select("p", F.explode(F.array_distinct(F.array("a", "b"))).alias("r")).groupBy("p", "r").agg(F.count("*").alias("d"))
    da, db = (ends.select("p", F.col("r").alias(x), F.col("d").alias(f"d{x}")) for x in "ab")
    return pairs.join(da, ["p", "a"]).join(db, ["p", "b"]).select("p", "a", "b", (F.col("lift") / F.pow(F.col("da") * F.col("db"), F.lit(alpha))).alias("lift"))


def arrays_by_key(applied: DataFrame) -> DataFrame:
    """``direction, p, q, cands, rules``: the candidates of each query in order, and their rule lists beside them."""
    rows = F.sort_array(F.collect_list(F.struct("cand", "rule_ids")))
    return applied.groupBy("direction", "p", "q").agg(rows.alias("x")).select("direction", "p", "q", F.col("x.cand").alias("cands"), F.col("x.rule_ids").alias("rules"))


def first_position(cands: str, gold: str):
    """Where the gold answer stands first among the candidates, from 0; -1 if it does not."""
    return (F.array_position(F.col(cands), F.col(gold)) - 1).cast("int")


def longest_list(applied: DataFrame):
    """``longest``: the most rules that a candidate has; 0 without candidates."""
    return applied.agg(F.coalesce(F.max(F.size("rule_ids")), F.lit(0)).alias("longest"))


def synergy_lines(lines: DataFrame) -> DataFrame:
    """``line, support, lift, rule1, rule2`` of the lines (``line``, ``value``) of a synergy file.

    A line has a leading field and then these four, between tabs, or between blanks if it has less
    than five by tabs; other lines are skipped.
    """
    tabs = F.split(F.trim("value"), "\t")
    f = F.when(F.size(tabs) >= 5, tabs).otherwise(F.split(F.trim("value"), r"\s+"))
    rows = lines.select("line", f.alias("f")).filter(F.size("f") >= 5)
    at = lambda n, kind: F.trim(F.col("f")[n]).try_cast(kind)
    return rows.select("line", at(1, "int").alias("support"), at(2, "double").alias("lift"), at(3, "int").alias("rule1"), at(4, "int").alias("rule2")).dropna()
