"""An audit of how far the sources of a language diverge in their words, with sketch-prefiltered counting.

Pass one counts in how many documents each term of a language occurs with a count-min
sketch of ``ROWS`` rows: tasks send the cells that they have touched, partial counts are
added up, and a bit a cell says whether it has reached the bound.  A sketch never
underestimates, so a term with an unset bit is in too few documents for certain and its
occurrences are dropped before anything is shuffled.  Pass two counts the terms left,
exactly: counts decide, so a false survivor costs shuffled rows and never changes a
result.  The sketch has ``CELLS_A_DOC`` cells a document and row, ``MAX_CELLS`` at most
(64 MB of bits are broadcast at any size; beyond it more terms survive for nothing).

The divergence of two sources sums a function of both shares over all kept terms.
Terms that a source lacks share one smoothed share, so only three sparse sums run:
terms that both sources have (a join by term), and for each of the two a histogram of
its counts against the other's share of an absent term.  The rest is one product.

Hot sources are counted in each task before the shuffle; a group has a row a term.

Defined results: null text, language and source are ``''``; empty texts count as
documents without terms; repeated rows are documents each; groups without a kept term
have shares of 1/V; ties go by the bytes of the item; an empty table gives an empty
result; columns of the input other than these three are not read.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, saved
from .words import LETTERS, Numbers, Places, shuffled, words

ROWS = 2
CELLS_A_DOC = 64
LEAST_CELLS, MAX_CELLS = 2**16, 2**28
BUCKET = 2**16
#: Occurrences of terms that a task holds before it sends them on, and terms that it remembers beyond that.
FLUSH = 2_000_000
FLUSH_TERMS = 600_000
#: Odd multipliers of the rows' hash functions.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SCALE = 1_000_000_000


def _cells(numbers: np.ndarray, lang: str, bits: int) -> list[np.ndarray]:
    """The cell of each row for the numbers of terms of a language."""
    h = shuffled(numbers + Numbers().of([lang.encode()]))
    return [(h * np.uint64(m)) >> np.uint64(64 - bits) for m in MULTIPLIERS[:ROWS]]


def _plain(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``lang, source, text`` with null as ``''``."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])


class Terms:
    """What a task holds of one language: its terms in the order they were seen, and the terms of its latest documents."""

    def __init__(self):
        self.places, self.numbers = Places(), np.empty(0, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.held, self.sizes, self.docs, self.groups = [], [], [], []

    def put(self, text: str | None, group: int) -> int:
        self.groups.append(group)
        many = 0
        for found in words(text, LETTERS):
            self.held.append(self.places.of(found))
            self.sizes.append(len(found))
            self.docs.append(len(self.groups) - 1)
            many += len(found)
        return many

    def once(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each document's group, each of its terms once, and how often it occurs; then they are forgotten."""
        self.numbers = np.concatenate([self.numbers, Numbers().of(list(islice(self.places, len(self.numbers), None)))])
        key = np.repeat(np.array(self.docs, np.int64), self.sizes) << 32 | np.concatenate([*self.held, np.empty(0, np.int64)])
        key, n = np.unique(key, return_counts=True)
        group = np.array(self.groups, np.int64)[key >> 32]
        self.clear()
        return group, key & 0xFFFFFFFF, n


def gathered(batches):
    """``language, terms, groups, group, place, n`` again and again: the terms of some documents, each once a document.

    ``batches``: ``lang, source, text``; ``groups`` are the sources, ``group`` their numbers.  A text's words are held together.
    """
    known: dict[str, Terms] = {}
    groups: dict[str, int] = {}
    size = 0

    def flush():
        for lang, terms in known.items():
            if terms.held:
                yield lang, terms, list(groups), *terms.once()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            size += known.setdefault(lang, Terms()).put(text.as_py(), groups.setdefault(source, len(groups)))
            if size > FLUSH:
                yield from flush()
                size = 0
                if sum(len(t.places) for t in known.values()) > FLUSH_TERMS:
                    known, groups = {}, {}
        release()
    yield from flush()


class Sketch:
    """The cells of a merged count-min sketch that have reached ``least`` documents, as bits."""

    def __init__(self, docs: DataFrame, least: int, cells: int):
        self.least, self.bits = least, cells.bit_length() - 1
        self.table = self._merged(docs)

    def _merged(self, docs: DataFrame) -> list[np.ndarray]:
        least, bits = self.least, self.bits
        buckets = max(1, (1 << bits) // BUCKET)
        fields = ("b", pa.int32()), ("at", pa.binary()), ("n", pa.binary())

        def touched(batches):
            for lang, terms, _, _, place, _ in gathered(batches):
                df = np.bincount(place, minlength=len(terms.places))
                some = np.flatnonzero(df)
                rows = []
                for row, cells in enumerate(_cells(terms.numbers[some], lang, bits) if len(some) else []):
                    order = np.argsort(cells)
                    cells, n = cells[order].astype(np.int64), df[some][order]
                    first = np.flatnonzero(np.diff(cells, prepend=-1))
                    cells, n = cells[first], np.add.reduceat(n, first)
                    cut = np.flatnonzero(np.diff(cells // BUCKET)) + 1
                    rows += [(row * buckets + int(p[0]) // BUCKET, (p % BUCKET).astype("<u2").tobytes(), np.minimum(c, least).astype("<u4").tobytes()) for p, c in zip(np.split(cells, cut), np.split(n, cut), strict=True)]
                yield from _batches(rows, *fields)

        def merge(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for b, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    sums.setdefault(b, np.zeros(BUCKET, np.int64))[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u4")
            yield from _batches(((b, np.packbits(n >= least, bitorder="little").tobytes(), b"") for b, n in sums.items()), *fields)

        schema = "b int, at binary, n binary"
        tasks = max(1, min(ROWS * buckets, ROWS * buckets // 64 + 8))
        merged = docs.mapInArrow(touched, schema).repartition(tasks, "b").mapInArrow(merge, schema)
        table = [np.zeros(buckets * BUCKET // 8, np.uint8) for _ in range(ROWS)]
        for b, at, _ in merged.toLocalIterator() if ROWS * buckets > 1024 else merged.collect():  # ROWS * MAX_CELLS bits at most
            table[b // buckets][b % buckets * BUCKET // 8 :][: len(at)] = np.frombuffer(at, np.uint8)
        return table

    def possible(self, numbers: np.ndarray, lang: str) -> np.ndarray:
        """Whether terms of a language may be in enough documents."""
        out = np.ones(len(numbers), bool)
        for table, cell in zip(self.table, _cells(numbers, lang, self.bits), strict=True):
            cell = cell.astype(np.int64)
            out &= (table[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
        return out


def _batches(rows, *fields, many: int = 1000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == many:
            yield _batch(held, fields)
            held = []
    if held:
        yield _batch(held, fields)


def _batch(rows, fields):
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], [name for name, _ in fields])


def counted(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """``lang, source, term, n, df``: occurrences and documents of the terms that the sketch leaves, exactly."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # ROWS * MAX_CELLS bits at most

    def run(batches):
        sketch = shared.value
        for lang, terms, groups, group, place, n in gathered(batches):
            kept = sketch.possible(terms.numbers, lang)[place]
            key, n = group[kept] << 32 | place[kept], n[kept]
            order = np.argsort(key)
            key, n = key[order], n[order]
            at = np.flatnonzero(np.diff(key, prepend=-1))
            n, df, key = np.add.reduceat(n, at) if len(at) else n, np.diff([*at, len(key)]), key[at]
            some, place = np.unique(key & 0xFFFFFFFF, return_inverse=True)
            names = list(terms.places)
            term = pa.array([names[x] for x in some.tolist()], pa.binary()).cast(pa.string()).take(pa.array(place))
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(key)), pa.array(groups, pa.string()).take(pa.array(key >> 32)), term, pa.array(n), pa.array(df)], ["lang", "source", "term", "n", "df"])

    sums = docs.mapInArrow(run, "lang string, source string, term string, n long, df long")
    return sums.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count, whole):
    """``1 + floor(SCALE * (count + 2) / whole)`` in whole numbers of any size."""
    top = (F.col(count) + 2 if isinstance(count, str) else count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", top, F.col(whole).cast("decimal(20,0)"))


def apart(p, q):
    """``floor((p - q)² / (p + q))``."""
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source", cells: int | None = None) -> DataFrame:
    """``lang, source, part, item, value, rank``; part ``pair`` has the other sources, part ``term`` the first ``top`` terms above the language's share."""
    given = _plain(docs, text, lang, source)
    cells = cells or min(MAX_CELLS, max(LEAST_CELLS, 1 << (CELLS_A_DOC * docs.count() - 1).bit_length()))
    counts = saved(counted(given, Sketch(given, least_docs, cells)), "counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("df").alias("df")).filter(F.col("df") >= least_docs).drop("df")
    kept = saved(counts.drop("df").join(terms, ["lang", "term"]), "kept")
    by_lang = kept.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n_all"))
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    groups = given.select("lang", "source").distinct().join(by_lang, "lang", "left").join(by_group, ["lang", "source"], "left")
    groups = groups.select("lang", "source", zero("v").alias("v"), (zero("n_all") + 2 * zero("v")).alias("whole_lang"), (zero("n_group") + 2 * zero("v")).alias("whole"))
    absent = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), "whole")).otherwise(1)
    groups = saved(groups.withColumn("p0", absent), "groups")
    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", share("n", "whole").alias("p"), share("n_lang", "whole_lang").alias("q"), "p0")
    shares = saved(shares, "shares")

    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = lambda rows, part: rows.withColumn("rank", F.row_number().over(place)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    above = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value"))
    found = out(above, "term").filter(F.col("rank") <= top)
    return out(_pairs(groups, shares), "pair").unionByName(found)


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of every two sources of a language, in both orders."""
    names = lambda df, x, *columns: df.select("lang", *[F.col(c).alias(f"{c}_{x}") for c in columns])
    one, two = names(groups, "a", "source", "p0"), names(groups, "b", "source", "p0", "v")
    every = one.join(two, "lang").filter("source_a <> source_b").select("lang", "source_a", "source_b", (F.col("v_b") * apart("p0_a", "p0_b")).alias("value"))
    # what a source's own terms add to the product, by how often they occur
    levels = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m"))
    own = names(levels, "a", "source", "p", "p0", "m").join(two, "lang").filter("source_a <> source_b")
    own = own.groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("m_a") * (apart("p_a", "p0_b") - apart("p0_a", "p0_b"))).alias("value"))
    # what terms of both add to that
    a, b = (shares.select("lang", "term", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "p", "p0")]) for x in "ab")
    more = apart("p_a", "p_b") - apart("p_a", "p0_b") - apart("p0_a", "p_b") + apart("p0_a", "p0_b")
    both = a.join(b, ["lang", "term"]).filter("source_a < source_b").groupBy("lang", "source_a", "source_b").agg(F.sum(more).alias("value"))
    turned = lambda df: df.select("lang", F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), "value")
    parts = every.unionByName(own).unionByName(turned(own)).unionByName(both).unionByName(turned(both))
    return parts.groupBy("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item")).agg(F.sum("value").alias("value"))
