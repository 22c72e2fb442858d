"""Sets of answers by node, as rows that stay bounded, joined along paths and counted without their pairs.

The answers of a node are cut into buckets of ``BUCKET`` ids.  Light nodes hold a bucket as
an array of positions of two bytes each, hubs as a bitmap; a row is at most ``BUCKET`` positions or 4 KB.
Following an edge is a union of rows: arrays of few neighbours are put together, and what a
hub with any number of neighbours reaches is OR-ed into one bitmap a bucket.  Pairs of
a start and an answer exist only where they are asked for.  Ids are whole numbers from 0;
dense ones fill buckets best.

Most nodes have few answers, which buckets would scatter over many rows.  :func:`followed` keeps those of a node
in one row and leaves buckets to the rest: nodes with many edges, or with an edge to a node of many answers.

Defined results: repeated edges change nothing; nodes without answers have no rows; null
ids are no answers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import saved
from .skew import dealt

#: Ids of a bucket, as the engine's bitmaps have them.
BUCKET = 32_768
#: A node with more neighbours than this is a hub.
HUB = 256
#: Up to so many answers of a node are in one row.
WHOLE = 4_096
#: Edges that a task has about, each with the answers at its end.
LISTS_A_TASK = 500_000


@dataclass
class Answers:
    """``light``: ``node, bucket, positions``; ``heavy``: ``node, bucket, bits``; a node is in one of them."""

    light: DataFrame
    heavy: DataFrame | None = None


def sets(pairs: DataFrame, node: str, answer: str, tasks: int | None = None) -> Answers:
    """The answers that ``pairs`` give each node; with ``tasks``, they meet in so many partitions."""
    rows = pairs.filter(F.col(node).isNotNull() & F.col(answer).isNotNull()).select(F.col(node).alias("node"), F.floor(F.col(answer) / BUCKET).cast("long").alias("bucket"), F.pmod(F.col(answer), F.lit(BUCKET)).cast("short").alias("position"))
    rows = rows if tasks is None else dealt(rows, tasks, "node", "bucket")
    return Answers(rows.groupBy("node", "bucket").agg(F.collect_set("position").alias("positions")))


def bits(positions: DataFrame) -> DataFrame:
    """``node, bucket, bits`` of ``node, bucket, positions``."""
    return positions.select("node", "bucket", F.explode("positions").alias("p")).groupBy("node", "bucket").agg(F.bitmap_construct_agg(F.col("p").cast("long")).alias("bits"))


def along(edges: DataFrame, found: Answers, node: str, to: str, hub: int = HUB, tasks: int | None = None) -> Answers:
    """What each ``node`` reaches by an edge to ``to`` and on; arrays meet in ``tasks`` partitions, if given."""
    edges = edges.select(F.col(node).alias("_from"), F.col(to).alias("node"))
    many = edges.groupBy("_from").agg(F.count("*").alias("n")).filter(F.col("n") > hub).select("_from")
    if found.heavy is not None:
        many = many.unionByName(edges.join(found.heavy.select("node").distinct(), "node", "left_semi").select("_from")).distinct()
    few = edges.join(many, "_from", "left_anti")
    reached = dealt(few.join(found.light, "node").select(F.col("_from").alias("node"), "bucket", "positions"), tasks, "node", "bucket")  # sets of neighbours seldom meet before that
    light = reached.groupBy("node", "bucket").agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("positions"))  # hub arrays at most
    hubs = edges.join(many, "_from", "left_semi").distinct()
    rows = bits(found.light.join(hubs.select("node").distinct(), "node", "left_semi"))
    rows = rows if found.heavy is None else rows.unionByName(found.heavy)
    heavy = hubs.join(rows, "node").groupBy(F.col("_from").alias("node"), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return Answers(light, heavy)


def pairs(found: Answers) -> DataFrame:
    """``node, answer``, each once."""
    out = found.light.select("node", "bucket", F.explode("positions").alias("p")).select("node", (F.col("bucket") * BUCKET + F.col("p")).alias("answer"))
    if found.heavy is None:
        return out
    byte = lambda i: F.conv(F.substring(F.hex("bits"), 2 * i + 1, 2), 16, 10).cast("int")
    bytes_ = F.transform(F.sequence(F.lit(0), F.lit(BUCKET // 8 - 1)), lambda i: F.struct(i.alias("i"), byte(i).alias("b")))
    held = found.heavy.select("node", "bucket", F.explode(F.filter(bytes_, lambda x: x["b"] > 0)).alias("x")).select("node", "bucket", "x.i", "x.b", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    held = held.filter("shiftright(b, k) % 2 = 1")
    return out.unionByName(held.select("node", (F.col("bucket") * BUCKET + F.col("i") * 8 + F.col("k")).alias("answer")))


def support(found: Answers, known: Answers) -> DataFrame:
    """``num_preds, num_true`` in one row: how many answers all nodes have, and how many of them ``known`` (light) has too."""
    own = known.light.withColumnRenamed("positions", "_known")
    light = found.light.join(own, ["node", "bucket"], "left").agg(F.coalesce(F.sum(F.size("positions")), F.lit(0)).alias("p"), F.coalesce(F.sum(F.when(F.col("_known").isNotNull(), F.size(F.array_intersect("positions", "_known"))).otherwise(0)), F.lit(0)).alias("t"))
    if found.heavy is None:
        return light.select(F.col("p").alias("num_preds"), F.col("t").alias("num_true"))
    both = found.heavy.join(own, ["node", "bucket"], "left_semi").unionByName(bits(known.light.join(found.heavy, ["node", "bucket"], "left_semi")))
    true = both.groupBy("node", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("t"))
    heavy = found.heavy.select(F.bitmap_count("bits").alias("p"), F.lit(0).cast("long").alias("t")).unionByName(true.select(F.lit(0).cast("long").alias("p"), "t"))
    every = light.select(F.col("p").cast("long"), F.col("t").cast("long")).unionByName(heavy)
    return every.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("num_preds"), F.coalesce(F.sum("t"), F.lit(0)).alias("num_true"))


@dataclass
class Followed:
    """``lists``: ``node, answers``, each node once, dealt by it into ``tasks`` partitions; ``rest``: the other nodes, if there are any."""

    lists: DataFrame
    rest: Answers | None
    tasks: int


def lists_of(pairs: DataFrame, node: str, answer: str, tasks: int, whole: int = WHOLE) -> DataFrame:
    """``node, low, high, big``: the different answers of a node in one row, in two arrays of the parts of the ids; empty if it is ``big``, with more than ``whole`` pairs."""
    rows = pairs.filter(F.col(node).isNotNull() & F.col(answer).isNotNull()).select(F.col(node).alias("node"), F.col(answer).cast("long").alias("answer"))
    rows = dealt(rows, tasks, "node").withColumn("_n", F.count("*").over(Window.partitionBy("node")))
    held = rows.groupBy("node").agg(F.sort_array(F.collect_set(F.when(F.col("_n") <= whole, F.col("answer")))).alias("x"), F.max(F.col("_n") > whole).alias("big"))
    return held.select("node", F.transform("x", lambda a: F.pmod(a, F.lit(BUCKET)).cast("short")).alias("low"), F.transform("x", lambda a: F.floor(a / BUCKET).cast("int")).alias("high"), "big")


def followed(edges: DataFrame, last: DataFrame, node: str, to: str, pairs: DataFrame, answer: str, hub: int = HUB) -> Followed:
    """What each ``node`` reaches by an edge to ``to`` and on to the answers that ``pairs`` give there; ``last``: the saved :func:`lists_of` these."""
    edges = edges.filter(F.col(node).isNotNull() & F.col(to).isNotNull()).select(F.col(node).alias("_from"), F.col(to).alias("node"))
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // LISTS_A_TASK))
    many, big = edges.groupBy("_from").agg(F.count("*").alias("n")).filter(F.col("n") > hub).select("_from"), last.filter("big").select("node")
    if not big.isEmpty():
        many = many.unionByName(edges.join(big, "node", "left_semi").select("_from")).distinct()
    many = saved(many, "many")
    rest = None
    if not many.isEmpty():
        rest = along(edges.join(many, "_from", "left_semi"), sets(pairs, to, answer, tasks), "_from", "node", hub, tasks)
        edges = edges.join(many, "_from", "left_anti")
    ends = dealt(edges, tasks, "node").join(dealt(last.select("node", "low", "high"), tasks, "node"), "node").select(F.col("_from").alias("node"), "low", "high")
    ids = F.flatten(F.transform(F.collect_list(F.struct("low", "high")), lambda x: F.zip_with(x["low"], x["high"], lambda a, b: b.cast("long") * BUCKET + a)))
    return Followed(dealt(ends, tasks, "node").groupBy("node").agg(F.array_distinct(ids).alias("answers")), rest, tasks)


def followed_pairs(found: Followed) -> DataFrame:
    """``node, answer``, each once."""
    out = found.lists.select("node", F.explode("answers").alias("answer"))
    return out if found.rest is None else out.unionByName(pairs(found.rest))


def followed_support(found: Followed, known: DataFrame, node: str, answer: str) -> DataFrame:
    """:func:`support` of ``found`` by the pairs ``known``, each once."""
    own = dealt(known.select(F.col(node).alias("node"), F.col(answer).cast("long").alias("a")), found.tasks, "node").groupBy("node").agg(F.collect_set("a").alias("_known"))
    true = F.when(F.col("_known").isNotNull(), F.size(F.array_intersect("answers", "_known"))).otherwise(0)
    every = found.lists.join(own, "node", "left").agg(F.sum(F.size("answers")).alias("num_preds"), F.sum(true).alias("num_true"))
    if found.rest is not None:
        every = every.unionByName(support(found.rest, sets(known, node, answer, found.tasks)).select(F.col("num_preds").cast("long"), F.col("num_true").cast("long")))
    return every.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("num_preds", "num_true")])
