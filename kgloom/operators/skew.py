"""Equi-joins whose hot keys are dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task of a dealt table has about, from where the session's partitions do not suffice.
ROWS_A_TASK = 2_000_000
#: A key is hot from so many rows of one side on.
LEAST_HOT = 20_000


def tasks_of(rows: DataFrame) -> int | None:
    """How many partitions hold about ``ROWS_A_TASK`` of the rows each; None if those that the session sets do."""
    needed = -(-rows.count() // ROWS_A_TASK)
    return needed if needed > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys``, unreduced: what later steps group or join by these keys, or group by more, needs no other shuffle."""
    return rows.repartition(*keys) if tasks is None else rows.repartition(tasks, *keys)


def hub_join(left: DataFrame, right: DataFrame, keys: list[str], least_hot: int = LEAST_HOT, most_pairs: int | None = None) -> DataFrame:
    """The inner join of two saved tables on ``keys``, each key's rows in tasks of a bounded share.

    Light keys meet by hash as they are.  A key is heavy if it has more rows on one side than
    ``least_hot`` and than a quarter of that side's mean partition, so there are at most four a
    partition and side, and the table of heavy keys is broadcast.  The left rows of a heavy key
    are dealt into as many lots as they fill such quarters, and so are its right rows; every
    pair of lots is joined in a place of its own, which copies a lot of one side once for each
    lot of the other.  With ``most_pairs`` a key is heavy too if it has more pairs of rows than that, and its left
    rows are dealt into so many lots that no place has many more; the result has that many pairs for each such key.
    """
    spark = left.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    quarter = [max(least_hot, -(-side.count() // (4 * tasks))) for side in (left, right)]
    lots = [side.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > q).select(*keys, F.ceil(F.col("n") / q).cast("int").alias(f"_lots_{name}")) for side, q, name in zip((left, right), quarter, "lr", strict=True)]
    heavy = lots[0].join(lots[1], keys, "full").fillna(1, ["_lots_l", "_lots_r"])  # four a partition and side at most
    if most_pairs is not None:
        n = [side.groupBy(*keys).agg(F.count("*").alias(f"_{name}")) for side, name in ((left, "l"), (right, "r"))]
        pairs = n[0].join(n[1], keys).filter(F.col("_l") * F.col("_r") > most_pairs)
        wide = pairs.join(heavy, keys, "left").fillna(1, ["_lots_l", "_lots_r"])
        needed = F.least(F.col("_l"), F.ceil(F.col("_l") * F.col("_r") / (F.col("_lots_r") * most_pairs)))
        wide = wide.select(*keys, F.greatest(F.col("_lots_l").cast("long"), needed).cast("int").alias("_lots_l"), "_lots_r")
        heavy = wide.unionByName(heavy.join(wide, keys, "left_anti"))
    if not heavy.take(1):
        return left.join(right, keys)
    heavy = F.broadcast(heavy)

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        known = side.join(heavy, keys, "left")
        lot = F.pmod(F.xxhash64(*[c for c in side.columns if c not in keys]), F.coalesce(F.col(f"_lots_{own}"), F.lit(1)))
        copies = F.sequence(F.lit(0), F.coalesce(F.col(f"_lots_{other}"), F.lit(1)) - 1)
        return known.select(*side.columns, lot.cast("int").alias(f"_{own}"), F.explode(copies).alias(f"_{other}"))

    return dealt(left, "l", "r").join(dealt(right, "r", "l"), [*keys, "_l", "_r"]).drop("_l", "_r")
