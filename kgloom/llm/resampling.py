"""Importance resampling towards a target distribution of hashed word n-grams.

A text's features are its runs of one and two words, hashed into ``BUCKETS`` buckets.
Tasks add up bucket counts of the corpus and of the target; an array of gains, one a
bucket, then scores each text with one look-up a feature.  A seeded Gumbel number of
the key is added, and the documents of the highest sums are drawn.

The draw is a distributed merge.  Each partition writes its rows as a sorted run;
every ``step``-th row of each run is a sample, at most ``SAMPLES`` and one a run, and
evenly spaced samples split the order into ranges.  Counts by range tell where a
range's ranks begin and which range holds the last draw.  The runs' segments of one
range meet in one task, which merges them with a tournament tree and stops after the
exact draw count; ranges behind it are neither merged nor shuffled.  The order of rows
is total (score, key, run, place in the run), so a range holds about ``RANGE_ROWS`` rows
even where many share a score or a key.

Defined results: null text has no words; texts without words have no features and
weight 0; a null key hashes as an empty one and stands behind every other key of its
score; repeated rows are drawn each by itself, in any order among equals; without a
target text all of its counts are 0; an empty table gives an empty result; columns of
the input other than key and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, saved
from .words import ALPHANUMERIC, words

BUCKETS = 10_000
RANGE_ROWS = 200_000
SAMPLES = 65_536
#: What orders rows: the score from the largest, the key, and where the row stands.
ORDER = ("score", "k", "run", "pos")


def features(text: str | None, buckets: int = BUCKETS):
    """Arrays of the buckets of a text's features, piece by piece, each with its number of words."""
    crc, last = zlib.crc32, []
    for found in words(text, ALPHANUMERIC):
        first = last + found
        pairs = map(crc, first[1:], [crc(b" ", c) for c in map(crc, first[:-1])])
        yield len(found), np.fromiter((*map(crc, found), *pairs), np.int64) % buckets
        last = found[-1:] or last


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: a row a bucket and task is shuffled."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0):
                for _, at in features(t.as_py(), buckets):
                    total += np.bincount(at, minlength=buckets)
            release()
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["b", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(text).mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():  # at most ``buckets``
        out[r.b] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the logarithm of the smoothed ratio of both shares of each bucket, rounded down."""
    many, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + many) / ((float(a) + 1) * (t + many)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(seed: int, key: str) -> int:
    """Thousand times a Gumbel number of seed and key, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gain: np.ndarray, seed: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``k, n_words, n_features, weight, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches):
        gain = shared.value
        for batch in batches:
            n_words, n_features, weight, score = [], [], [], []
            for k, t in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                many = total = count = 0
                for n, at in features(t.as_py(), len(gain)):
                    many, total, count = many + n, total + int(gain[at].sum()), count + len(at)
                w = total // count if count else 0
                n_words.append(many)
                n_features.append(count)
                weight.append(w)
                score.append(w + gumbel(seed, k or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (n_words, n_features, weight, score)]], ["k", "n_words", "n_features", "weight", "score"])
            release()

    given = docs.select(F.col(key).alias("k"), F.col(key).cast("string").alias("s"), F.col(text).alias("t"))
    return given.mapInArrow(run, f"k {docs.schema[key].dataType.simpleString()}, n_words long, n_features long, weight long, score long")


class Tournament:
    """A tree of matches between the heads of sorted runs; the smallest head wins at the root."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.leaves = 1 << max(0, len(runs) - 1).bit_length()
        self.tree: list[tuple | None] = [None] * (2 * self.leaves)
        for n in range(len(runs)):
            self.tree[self.leaves + n] = self._head(n)
        for node in range(self.leaves - 1, 0, -1):
            self.tree[node] = self._match(node)

    def _head(self, n: int):
        return (self.runs[n][self.at[n]], n) if self.at[n] < len(self.runs[n]) else None

    def _match(self, node: int):
        a, b = self.tree[2 * node], self.tree[2 * node + 1]
        return a if b is None or a is not None and a <= b else b

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The winning run and the places from where to where its rows come next, at most so many; None at the end."""
        best = self.tree[1]
        if best is None:
            return None
        n = best[1]
        node, second = self.leaves + n, None
        while node > 1:  # the best that the winner beat on its way
            other = self.tree[node ^ 1]
            second = other if second is None or other is not None and other < second else second
            node >>= 1
        begin = self.at[n]
        end = len(self.runs[n]) if second is None else max(begin + 1, bisect_right(self.runs[n], second[0], begin))
        self.at[n] = end = min(end, begin + most)
        node = self.leaves + n
        self.tree[node] = self._head(n)
        while node > 1:
            node >>= 1
            self.tree[node] = self._match(node)
        return n, begin, end


def _keys(score, k, run, pos) -> list[tuple]:
    return [(-s, x is None, x or 0, r, p) for s, x, r, p in zip(score, k, run, pos, strict=True)]


def _behind(cut: tuple):
    """A column: whether a row stands at the splitter ``cut`` or behind it."""
    score, no_key, k, run, pos = cut
    key, missing = F.coalesce("k", F.lit(0)), F.col("k").isNull()
    place = (F.col("run") > run) | (F.col("run") == run) & (F.col("pos") >= pos)
    same = (missing == F.lit(no_key)) & (key == k) & place
    later = (key > k) & (missing == F.lit(no_key)) | missing & ~F.lit(no_key)
    return (F.col("score") < -score) | (F.col("score") == -score) & (later | same)


def drawn(rows: DataFrame, eligible, share: int, key: str) -> DataFrame:
    """``rows`` (``k, score`` and others) with ``rank`` from 1 for ``share`` per cent of the eligible ones, those of the largest scores, else null."""
    spark, kept = rows.sparkSession, [c for c in rows.columns if c != "n_words"]
    runs = rows.withColumns({"run": F.spark_partition_id(), "_e": eligible}).sortWithinPartitions(F.desc("_e"), F.desc("score"), F.asc_nulls_last("k"))
    runs = saved(runs.withColumn("pos", F.monotonically_increasing_id() % F.lit(2**33)), "runs")
    n = runs.filter("_e").count()
    draw = share * n // 100
    out = [*kept, "rank"]
    if not draw:
        return runs.withColumn("rank", F.lit(None).cast("long")).select(*[F.col(c).alias(key) if c == "k" else F.col(c) for c in out])
    step = max(1, n // SAMPLES)
    found = runs.filter(F.col("_e") & (F.col("pos") % step == 0)).select(*ORDER).collect()  # at most SAMPLES and one a run
    samples = sorted(_keys(*zip(*found, strict=True)))
    ranges = max(-(-n // RANGE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    splitters = samples[:: max(1, len(samples) // ranges)][1:]
    shared = spark.sparkContext.broadcast(splitters)

    def cuts(batch):
        """Pieces of the batch that lie in one run and one range: the range, from where, to where."""
        keys = _keys(*[batch.column(c).to_pylist() for c in ORDER])
        run, pos = batch.column("run").to_numpy(), batch.column("pos").to_numpy()
        ends = [*(np.flatnonzero((run[1:] != run[:-1]) | (pos[1:] < pos[:-1])) + 1).tolist(), len(keys)]
        at = 0
        for end in ends:
            while at < end:
                number = bisect_right(shared.value, keys[at])
                to = end if number == len(shared.value) else bisect_left(keys, shared.value[number], at, end)
                yield number, at, to
                at = to

    def count(batches):
        total = np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            for number, at, end in cuts(batch):
                total[number] += end - at
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["range", "n"])

    counted = {r.range: r.n for r in runs.filter("_e").select(*ORDER).mapInArrow(count, "range long, n long").groupBy("range").agg(F.sum("n").alias("n")).collect()}  # a row a range
    before = np.cumsum([0, *[counted.get(r, 0) for r in range(len(splitters) + 1)]])
    last = int(np.searchsorted(before, draw, "left")) - 1  # the range of the last draw
    base = before[: last + 1].tolist()

    def segments(batches):
        for batch in batches:
            parts = [(number, batch.slice(at, end - at)) for number, at, end in cuts(batch)]
            if parts:
                lists = [pa.array([p.column(c).to_pylist() for _, p in parts], pa.list_(batch.schema.field(c).type)) for c in batch.schema.names]
                yield pa.RecordBatch.from_arrays([pa.array([number for number, _ in parts], pa.int32()), *lists], ["range", *batch.schema.names])

    def merge(group):
        number = group.column("range")[0].as_py()
        columns = {c: group.column(c).to_pylist() for c in group.schema.names if c != "range"}
        tree = Tournament([_keys(*[columns[c][x] for c in ORDER]) for x in range(group.num_rows)])
        left, taken = draw - base[number], []
        while left > 0 and (got := tree.take(left)):
            taken.append(got)
            left -= got[2] - got[1]
        ranks = sum(end - at for _, at, end in taken)
        taken += [(x, at, len(run)) for x, (at, run) in enumerate(zip(tree.at, tree.runs, strict=True))]
        ordered = [pa.array([v for x, at, end in taken for v in columns[c][x][at:end]], group.schema.field(c).type.value_type) for c in kept]
        rank = [base[number] + 1 + i if i < ranks else None for i in range(len(ordered[0]))]
        return pa.table([*ordered, pa.array(rank, pa.int64())], names=out)

    head, rest = F.col("_e"), ~F.col("_e")
    if last < len(splitters):
        head, rest = head & ~_behind(splitters[last]), rest | _behind(splitters[last])
    kinds = dict(runs.dtypes)
    columns = list(dict.fromkeys([*kept, *ORDER]))
    packed = runs.filter(head).select(*columns).mapInArrow(segments, "range int, " + ", ".join(f"{c} array<{kinds[c]}>" for c in columns))
    first = packed.groupBy("range").applyInArrow(merge, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", rank long")
    both = first.unionByName(runs.filter(rest).select(*kept, F.lit(None).cast("long").alias("rank")))
    return both.select(*[F.col(c).alias(key) if c == "k" else F.col(c) for c in out])


def resample(docs: DataFrame, target: DataFrame, share: int = 25, seed: int = 7, least_words: int = 20, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``key, n_features, weight, score, rank`` of every row of ``docs``; ``share`` per cent of those with enough words are drawn."""
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets))
    return drawn(weighted(docs, gain, seed, key, text), F.col("n_words") >= least_words, share, key)
