"""Language identification with a bit-sliced Bloom filter of n-grams.

A slot of the filter is a bitmask with a bit for each language.  Looking an
n-gram up ANDs the masks of its ``HASHES`` slots, which gives all languages that
contain it.  The hits of a language over all n-grams of a text, as a share and
corrected for the false positives that its fill of the filter predicts, are its
score; the largest decides.

An n-gram is ``N`` (4 at most) bytes of UTF-8 after lower-casing A-Z and turning digits,
punctuation and white space of ASCII to blanks.  A language contains it if at
least ``MIN_RATE`` of its sampled documents have it, and at least ``SHARE`` of
the rate in the language that has it most.  The sample is about
``SAMPLE_DOCS`` labelled texts a language, chosen by a hash of the text, so
the model's size does not grow with the corpus, keys have no part in it, and copies
of a text count once in a language.

Defined results: null text and texts without a letter are ``und`` with score 0;
texts with letters but no known n-gram, and ties, go to the language with the
most labelled documents (then by name); rows with null language are not learned
from; without any labelled row everything is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import chunks
from .common import release, saved

N = 4
HASHES = 3
SAMPLE_DOCS = 2_000
MIN_RATE = 0.004
SHARE = 0.2
SLOTS_PER_GRAM = 16
#: Bytes of the texts that are looked up at a time.
SLICE = 400_000
#: Odd multipliers of the hash functions.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

_plain = np.arange(256, dtype=np.uint8)
_plain[:128] = 32
_plain[97:123] = np.arange(97, 123)
_plain[65:91] = np.arange(97, 123)


def grams(texts: list[str | None], piece: int = 1_000_000):
    """Pairs of row numbers and n-grams (as numbers) of the texts, piece by piece."""
    for row, data in enumerate(_joined(texts, piece)):
        index, body = data
        g = np.zeros(max(0, len(body) - N + 1), np.uint64)
        whole = np.ones(len(g), bool)
        for k in range(N):
            part = body[k : k + len(g)]
            g |= part.astype(np.uint64) << np.uint64(8 * k)
            whole &= part != 0
        yield index[: len(g)][whole], g[whole]


def _joined(texts, piece):
    """Texts as cleaned bytes with a zero after each, in arrays of about ``piece`` bytes; long texts are cut with an overlap."""
    rows, parts, held = [], [], 0
    for row, t in enumerate(texts):
        data = _plain[np.frombuffer((t or "").encode("utf-8"), np.uint8)]
        for at in range(0, max(1, len(data)), piece):
            part = data[at : at + piece + N - 1]
            rows.append(np.full(len(part) + 1, row, np.int32))
            parts += [part, np.zeros(1, np.uint8)]
            held += len(part)
            if held >= piece:
                yield np.concatenate(rows), np.concatenate(parts)
                rows, parts, held = [], [], 0
    if rows:
        yield np.concatenate(rows), np.concatenate(parts)


class Model:
    """Languages and their filter."""

    def __init__(self, languages: list[str], known: list[tuple[int, list[int]]]):
        self.languages = languages
        self.words = max(1, -(-len(languages) // 64))
        self.bits = max(10, (SLOTS_PER_GRAM * max(1, len(known))).bit_length())
        self.table = np.zeros((self.words, 1 << self.bits), np.uint64)
        if known:
            g = np.array([k for k, _ in known], np.uint64)
            masks = np.zeros((self.words, len(known)), np.uint64)
            for n, (_, langs) in enumerate(known):
                for i in langs:
                    masks[i // 64, n] |= np.uint64(1 << i % 64)
            for at in self.slots(g):
                for w in range(self.words):
                    np.bitwise_or.at(self.table[w], at, masks[w])
        ones = [np.count_nonzero(self.table[i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(languages))]
        #: Chance that an n-gram of no language seems to be in it.
        self.false = (np.array(ones) / (1 << self.bits)) ** HASHES

    def slots(self, g: np.ndarray):
        for m in MULTIPLIERS[:HASHES]:
            yield (g * np.uint64(m)) >> np.uint64(64 - self.bits)

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """Corrected share of each text's n-grams that each language contains."""
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for row, g in grams(texts):
            total += np.bincount(row, minlength=len(texts))
            slots = list(self.slots(g))
            for w in range(self.words):
                mask = self.table[w][slots[0]]
                for s in slots[1:]:
                    mask &= self.table[w][s]
                held = np.flatnonzero(mask)
                r, mask = row[held], mask[held]
                for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                    hits[:, i] += np.bincount(r[(mask >> np.uint64(i % 64) & np.uint64(1)).astype(bool)], minlength=len(texts))
        raw = hits / np.maximum(total, 1)[:, None]
        return np.clip((raw - self.false) / (1 - np.minimum(self.false, 0.99)), 0, 1)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from the rows whose ``lang`` and ``text`` are not null."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = sorted(((r.l, r.n) for r in rows.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).collect()), key=lambda x: (-x[1], x[0]))
    if not counts:
        return Model([], [])
    languages = [x for x, _ in counts]
    known = rows.sparkSession.createDataFrame([(l, i, int(2**30 * min(1.0, sample_docs / n))) for i, (l, n) in enumerate(counts)], f"_lang {labelled.schema[lang].dataType.simpleString()}, l int, _bound long")
    place = F.xxhash64(F.col(text))
    chosen = rows.select(F.col(lang).alias("_lang"), F.col(text).alias("t"), place.alias("_at")).join(F.broadcast(known), "_lang")  # a row a language, as in the model
    sample = chosen.filter(F.pmod("_at", F.lit(2**30)) < F.col("_bound")).groupBy("l", "_at").agg(F.first("t").alias("t")).select("l", "t")

    def count(batches):
        for batch in batches:
            langs = batch.column(0).to_numpy()
            for at, part in chunks(batch.column(1), SLICE):
                of = langs[at : at + len(part)]
                seen = [np.unique(row.astype(np.uint64) << np.uint64(32) | g) for row, g in grams(part)]
                pairs = np.unique(np.concatenate(seen))  # once for each document; an n-gram has 32 bits
                by_lang = of[(pairs >> np.uint64(32)).astype(int)].astype(np.uint64) << np.uint64(32) | pairs & np.uint64(0xFFFFFFFF)
                both, n = np.unique(by_lang, return_counts=True)
                both = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([pa.array(both[0].astype("int32")), pa.array(both[1].astype("int64")), pa.array(n)], ["l", "g", "n"])
            release()
            docs = np.bincount(langs, minlength=len(languages))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(languages), dtype="int32")), pa.array(np.full(len(languages), -1)), pa.array(docs)], ["l", "g", "n"])

    counted = saved(sample.mapInArrow(count, "l int, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")), "grams")
    totals = counted.filter("g = -1").select("l", F.greatest("n", F.lit(1)).cast("double").alias("_docs"))
    rates = counted.filter("g >= 0").join(F.broadcast(totals), "l").select("g", F.struct((F.col("n") / F.col("_docs")).alias("rate"), "l").alias("r")).filter(f"r.rate >= {MIN_RATE}")  # a row a language
    lists = rates.groupBy("g").agg(F.max("r.rate").alias("top"), F.collect_list("r").alias("r"))  # an entry for each language at most
    held = lists.select("g", F.transform(F.filter("r", lambda x: x["rate"] >= F.col("top") * SHARE), lambda x: x["l"]).alias("ls"))
    return Model(languages, [(r.g, sorted(r.ls)) for r in held.orderBy("g").toLocalIterator()])


def judgement(spark, model: Model, text):
    """A column ``lang_pred, score`` of the text column ``text``; only the texts go to Python, in small slices."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def judge(texts):
        import regex

        letter, m = regex.compile(r"\p{L}"), shared.value
        names, scores = [], []
        for _, part in chunks(texts, SLICE):
            known = np.array([bool(m.languages and t and letter.search(t)) for t in part], bool)
            shares = m.shares(part) if m.languages else np.zeros((len(part), 1))
            best = shares.argmax(axis=1)
            names += [m.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
            scores += np.where(known, shares.max(axis=1), 0.0).tolist()
        release()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return judge(F.col(text) if isinstance(text, str) else text)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] = ()) -> DataFrame:
    """``key``, the columns in ``keep``, ``lang_pred`` and ``score`` of every row."""
    judged = docs.select(F.struct(F.col(key), *keep).alias("_row"), judgement(docs.sparkSession, model, text).alias("_j"))
    return judged.select(*[F.col(f"_row.`{c}`").alias(c) for c in (key, *keep)], "_j.lang_pred", "_j.score")
