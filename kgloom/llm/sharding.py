"""Sharding by longest-processing-time scheduling of groups that stay together.

Groups of equal texts, sorted by size, go to the least-loaded shard through a
heap.  One task cannot hold all groups of a large corpus, so beyond ``BUNDLES``
groups the rule is applied twice: each of ``parts`` tasks first schedules its
own groups onto bundles, then the bundles, sorted by size, are scheduled onto
the shards.  A shard's load is then off by at most about one of ``BUNDLES``
bundles, and a group of any size still stays in one shard.

Slots are numbered without bringing a shard together: every task numbers its own
rows of each shard, and the prefix sums of the counts (one row for each task and
shard) are added.

Defined results: null text counts as empty text of 0 bytes and shares its group;
repeated rows are rows of their own; null keys are allowed; ties in size go by
the group's digest.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

BUNDLES = 16_384
GROUPS_A_TASK = 200_000


def lpt(sizes, bins: int) -> list[int]:
    """The bin of each item; the items come largest first."""
    heap = [(0, b) for b in range(bins)]
    out = []
    for size in sizes:
        load, b = heap[0]
        heapq.heapreplace(heap, (load + size, b))
        out.append(b)
    return out


def group_shards(groups: DataFrame, shards: int, bundles: int = BUNDLES, task_groups: int = GROUPS_A_TASK) -> DataFrame:
    """``g, shard`` of groups ``g, weight``."""
    parts = -(-max(1, groups.count()) // task_groups)
    each = max(shards, bundles // parts)

    def bundle(pdf):
        pdf = pdf.sort_values(["weight", "g"], ascending=[False, True])
        pdf["bundle"] = pdf["part"] * each + lpt(pdf["weight"].tolist(), each)
        return pdf[["g", "weight", "bundle"]]

    def schedule(pdf):
        pdf = pdf.sort_values(["weight", "bundle"], ascending=[False, True])
        pdf["shard"] = np.array(lpt(pdf["weight"].tolist(), shards), "int32")
        return pdf[["bundle", "shard"]]

    bundled = saved(groups.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(parts))).groupBy("part").applyInPandas(bundle, "g string, weight long, bundle long"), "bundles")
    loads = bundled.groupBy("bundle").agg(F.sum("weight").alias("weight"))  # at most max(BUNDLES, shards * parts) rows
    placed = loads.groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: schedule(pdf), "bundle long, shard int")
    return bundled.join(F.broadcast(placed), "bundle").select("g", "shard")


def shard_documents(docs: DataFrame, shards: int = 8, law: str = "bytes", key: str = "doc_id", text: str = "text", bundles: int = BUNDLES, task_groups: int = GROUPS_A_TASK) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``law``: ``bytes`` evens out the sum of ``size`` (UTF-8 bytes of the text plus
    1), ``rows`` the number of rows, as far as the largest group allows.  Either
    schedules anew for another number of shards, so ``grown_shard`` is null.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"law must be bytes or rows, not {law!r}")
    t = F.coalesce(F.col(text), F.lit(""))
    rows = saved(docs.select(F.col(key).alias("k"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.sha2(t, 256).alias("g")), "sizes")
    weight = F.sum("size") if law == "bytes" else F.count("*")
    groups = saved(rows.groupBy("g").agg(weight.alias("weight")), "groups")
    where = saved(group_shards(groups, shards, bundles, task_groups), "shards")

    def number(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            shard = batch.column(3).to_numpy()
            slot = np.empty(len(shard), np.int64)
            for s in range(shards):
                at = np.flatnonzero(shard == s)
                slot[at] = seen[s] + np.arange(len(at))
                seen[s] += len(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slot), pa.array(np.full(len(shard), task, "int32"))], [*batch.schema.names, "local", "task"])

    kind = rows.schema["k"].dataType.simpleString()
    placed = rows.join(where, "g").select("k", "size", "text_crc32", "shard")
    placed = saved(placed.mapInArrow(number, f"k {kind}, size long, text_crc32 long, shard int, local long, task int"), "placed")
    counts = placed.groupBy("shard", "task").agg(F.count("*").alias("n"))  # a row for each task and shard
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(F.broadcast(base), ["shard", "task"]).select(F.col("k").alias(key), "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("local") + F.col("base")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
