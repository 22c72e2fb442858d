"""Exact deduplication with two passes over a Bloom filter.

Pass one: every task sets ``HASHES`` positions of a filter for each text's
digest, in two bitmaps (set, and set again), and sends these on as the lists of
its positions, two bytes each; merged, they tell the positions that were set more
than once.  Pass two looks every digest up: if any of its positions was set once
only, the text is unique and its row passes straight through.  Only the rows
left, the repeated texts and a few false positives, shuffle and are grouped by
the strong digest.  Digests decide, so a false positive costs a shuffled row and
never changes a result.

The filter has ``BITS_PER_ROW`` bits a key.  Of up to ``FIRST_BITS`` bits (64 MB, 33
million rows) its keys are all digests, as above.  Of more rows, the digests alone,
never the rows, are first counted by partial aggregation, and the filter's keys are
those that are repeated.  It then grows with the repeated texts to at most
``MOST_BITS`` bits (256 MB); beyond them more rows shuffle in vain, and results stay
the same.  There is one filter at any size, so a table is scanned once for its
digests and once for each side of pass two.

A text that a third of the rows share sets its positions once a task, is counted
by partial aggregation, and its rows are left to the skew-join splitting of
adaptive execution.

Defined results: null text counts as empty; rows that share key and text are all
kept or all dropped together by :func:`exact_dedup` and leave one row in
:func:`deduplicated`; null keys are smaller than any other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, saved

BITS_PER_ROW = 16
HASHES = 2
#: The largest filter of all digests.
FIRST_BITS = 2**29
#: The largest filter of digests known to be repeated.
MOST_BITS = 2**31
#: Positions that a task holds before it sends them on.
FLUSH = 2_000_000
BUCKET = 2**16


def digests(texts: pa.Array) -> list[str]:
    """The SHA-256 of each text (binary) after lower-casing A-Z."""
    return [hashlib.sha256((t.as_py() or b"").lower()).hexdigest() for t in texts]  # bytes.lower() knows A-Z only


def folded_sha256(text):
    """A column: the SHA-256 of a text column after lower-casing A-Z, null counted as empty."""

    @F.arrow_udf("string")
    def digest(texts):
        return pa.array(digests(texts), pa.string())

    return digest(F.col(text).cast("binary"))


def _words(column: pa.Array) -> np.ndarray:
    """The first two 64-bit words of each hex digest."""
    return np.frombuffer(bytes.fromhex("".join(x[:32] for x in column.to_pylist())), ">u8").astype(np.uint64).reshape(-1, 2)


class Filter:
    """The filter of the digests (hex columns) of a table, ``bits`` bits as a broadcast.

    ``maybe`` makes a boolean column: whether all positions of a digest were set at
    least ``least`` times.
    """

    def __init__(self, rows: DataFrame, digest: str, bits: int, least: int):
        self.bits = bits
        self.table = rows.sparkSession.sparkContext.broadcast(self._built(rows, digest, least))

    def _built(self, rows: DataFrame, digest: str, least: int) -> np.ndarray:
        bits = self.bits

        def place(batches):
            held, size = [], 0

            def flush():
                p, n = np.unique(np.concatenate(held), return_counts=True)
                for at, part in ((0, p), (1, p[n > 1])):
                    bucket = part // BUCKET
                    for b, x, y in zip(*_runs(bucket), strict=True):
                        yield b, at, (part[x:y] % BUCKET).astype("<u2").tobytes()

            for batch in batches:
                held.append(_positions(_words(batch.column(0)), bits).reshape(-1))
                size += len(held[-1])
                if size > FLUSH:
                    yield from _rows(flush())
                    held, size = [], 0
                    release()
            if size:
                yield from _rows(flush())

        def merge(batches):
            once: dict[int, np.ndarray] = {}
            twice: dict[int, np.ndarray] = {}
            for batch in batches:
                for b, again, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    seen = once.setdefault(b, np.zeros(BUCKET, bool))
                    low = np.frombuffer(low, "<u2")
                    if again:
                        twice.setdefault(b, np.zeros(BUCKET, bool))[low] = True
                    else:
                        twice.setdefault(b, np.zeros(BUCKET, bool))[low[seen[low]]] = True
                        seen[low] = True
            out = once if least == 1 else twice
            for b, m in out.items():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([0], pa.int32()), pa.array([np.packbits(m, bitorder="little").tobytes()], pa.binary())], ["b", "again", "low"])

        schema = "b int, again int, low binary"
        placed = rows.select(digest).mapInArrow(place, schema)
        buckets = -(-bits // BUCKET)
        merged = placed.repartition(max(1, min(buckets, buckets // 64 + 8)), "b").mapInArrow(merge, schema)
        table = np.zeros(buckets * BUCKET // 8, np.uint8)
        for b, _, low in merged.toLocalIterator() if buckets > 1024 else merged.collect():  # at most MOST_BITS bits
            table[b * BUCKET // 8 :][: len(low)] = np.frombuffer(low, np.uint8)
        return table

    def maybe(self, digest):
        shared, bits = self.table, self.bits

        @F.arrow_udf("boolean")
        def look_up(column):
            return pa.array(_held(shared.value, _words(column), bits))

        return look_up(digest)


def _runs(sorted_values: np.ndarray):
    """The values of runs of equal ones, and where each begins and ends."""
    cuts = np.flatnonzero(np.diff(sorted_values)) + 1
    starts = np.concatenate([[0], cuts]).astype(int) if len(sorted_values) else np.empty(0, int)
    return sorted_values[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(sorted_values)][: len(starts)]


def _rows(found, many: int = 1000):
    held = []
    for row in found:
        held.append(row)
        if len(held) == many:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows):
    b, again, low = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(again, pa.int32()), pa.array(low, pa.binary())], ["b", "again", "low"])


def _positions(words: np.ndarray, bits: int) -> np.ndarray:
    return (words % np.uint64(bits)).astype(np.int64)


def _held(table: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    p = _positions(words, bits)
    return ((table[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool).all(axis=1)


def filter_of(rows: DataFrame, digest: str, least: int = 2, first_bits: int = FIRST_BITS, most_bits: int = MOST_BITS) -> Filter:
    """Pass one over a saved table: the filter of its digests that occur ``least`` (1 or 2) times or more."""
    many = rows.count()
    if BITS_PER_ROW * many > first_bits:
        rows = saved(rows.groupBy(digest).count().filter(F.col("count") >= least).select(digest), "keys")
        many, least = rows.count(), 1
    bits = min(BITS_PER_ROW * max(1, many), most_bits)
    return Filter(rows, digest, -(-bits // BUCKET) * BUCKET, least)


def split(df: DataFrame, digest, found: Filter) -> tuple[DataFrame, DataFrame]:
    """Pass two: the rows of ``df`` whose digest may be repeated, and those whose digest is not."""
    return df.filter(found.maybe(digest)), df.filter(~found.maybe(digest))


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``k, text_sha256`` of each row's text after lower-casing A-Z."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests(batch.column(1)), pa.string())], ["k", "text_sha256"])
            release()

    return docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).mapInArrow(run, f"k {kind}, text_sha256 string")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", first_bits: int = FIRST_BITS) -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256`` of every row; see the module's text."""
    rows = saved(fingerprints(docs, key, text), "fingerprints")
    possible, unique = split(rows, F.col("text_sha256"), filter_of(rows, "text_sha256", first_bits=first_bits))
    once = unique.select("k", F.col("k").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    possible = saved(possible, "possible")
    groups = saved(possible.groupBy("text_sha256").agg(F.max("k").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"), "copies")
    joined = possible.join(groups, "text_sha256", "left").select(
        "k",
        F.when(F.col("group_size").isNull(), F.col("k")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("group_size").isNull(), True).otherwise(F.col("k").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
    return once.unionByName(joined).withColumnRenamed("k", key)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", first_bits: int = FIRST_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts that with the largest key.

    Unique rows pass from the scan to the result without a shuffle.  Possibly
    repeated ones are reduced to one row a text in each task, and these are
    grouped.  Of rows that share key and text, one with the largest original text
    stays.
    """
    rows = saved(fingerprints(docs, key, text).select("text_sha256"), "fingerprints")
    row = F.struct(*[docs[c] for c in docs.columns])
    given = docs.select(row.alias("row"), folded_sha256(text).alias("digest"))
    possible, unique = split(given, F.col("digest"), filter_of(rows, "text_sha256", first_bits=first_bits))
    first = possible.groupBy("digest").agg(F.max_by("row", F.struct(F.col(f"row.`{key}`").alias("k"), F.col(f"row.`{text}`").alias("t"))).alias("row"))
    return unique.select("row.*").unionByName(first.select("row.*"))
