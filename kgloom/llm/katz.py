"""Katz backoff scoring of texts with a bigram model of the corpus.

Tokens are the words of a text and one end.  :func:`train` counts words and pairs of
words of all its texts, :func:`score` gives each text the model's probability.

A pair that was counted c times behind a context of ``whole`` tokens has probability
``d(c) c / whole``; ``d`` is Katz's Good-Turing discount up to ``K`` counts, 1 beyond.
Any other pair backs off: ``alpha(context)`` times the probability of the word alone,
and a word that was never seen backs off once more, to the one class of unknown words,
which has the Good-Turing mass of unseen words.  ``alpha`` is what the discounts leave
over, divided by what the context's unseen words hold in the lower model, so each
context sums up to exactly 1.  Where counts of counts give no discount between 0 and
1 (few or strange counts), an absolute discount replaces it; a context with nothing to
discount counts one token more.  A context that was never seen leaves the word alone.

Tables: ``grams``, the counted pairs and rare words, dealt by a hash of the context to
parts that grow in number with the corpus, and ``contexts``.  Contexts that hold much of
the corpus are dealt over several parts, in proportion to their counts, and their sums
are put together by a grouping.  The ``HEAD_WORDS`` most frequent words at most, with
their counts, are broadcast.  Each block of texts sends the distinct pairs that it holds
to their parts, which answer with counts; sent arrays are packed, so this is a few bytes
a pair.  Words are told apart by 63-bit hashes.

Defined results: null text counts as empty and is one end token; repeated rows and keys
are scored each by itself; a null key stays null; very long texts are cut over blocks, a
block's first token knows the one before; without training texts every probability is
1; an empty table gives an empty result; columns other than key and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, saved
from .words import BLANKS, Numbers, shuffled, words

#: Counts up to which Good-Turing discounts apply.
K = 5
HEAD_WORDS = 2**18
#: Tokens of a block of texts, and of the corpus for each part.
BLOCK = 1_000_000
PART = 4_000_000
#: Distinct words that a task counts before it sends them on.
FLUSH_WORDS = 600_000
#: No words, as they hold blanks or nothing: the end of a text, its beginning, and the context of words alone.
END, BEGIN, ALONE = b"", b" ", b"  "
RARE = np.uint64(1 << 63)
PACKED = "part int, kind int, block long, a binary, b binary, c binary"
GRAMS, CONTEXTS, ASKED = 0, 1, 2


def discounts(n: list[int]) -> list[float]:
    """``d(0), ..., d(K)`` from how many things were counted 1, ..., K + 1 times; ``d(0)`` is not used."""
    cut = (K + 1) * n[K] / n[0] if n[0] else 1.0
    flat = min(0.75, n[0] / (n[0] + 2 * n[1])) if n[0] else 0.5
    out = [1.0]
    for r in range(1, K + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut) if n[r - 1] and cut < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - flat) / r)
    return out


def pack(x: np.ndarray) -> bytes:
    """Numbers byte by byte of their places, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x.astype("<u8"), prepend=np.uint64(0)))  # wraps, and so does its sum


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


class Head:
    """The most frequent words by their hashes, numbered from 0 by falling count, and the model's single numbers."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, vocabulary: int, ends: int, of_counts: list[int], parts: int):
        order = np.lexsort((hashes, -counts))
        self.counts = counts[order]
        by_hash = np.argsort(hashes[order])
        self.hashes, self.rank = hashes[order][by_hash], by_hash.astype(np.uint64)
        self.tokens, self.vocabulary, self.parts = tokens, vocabulary, parts
        self.d = np.array(discounts(of_counts))
        left = sum((1 - self.d[r]) * r * of_counts[r - 1] for r in range(1, K + 1))
        self.whole = tokens if left > 0 else tokens + 1
        self.unknown = (left if left > 0 else 1.0) / self.whole
        self.pair_d = self.d
        self.end, self.begin, self.alone = self.ids(Numbers().of([END, BEGIN, ALONE]))
        self.ends = ends

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words: their rank in the head, or their hash with the highest bit set."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        found = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        return np.where(found, self.rank[at] if len(self.hashes) else 0, hashes | RARE)

    def alone_p(self, counts: np.ndarray) -> np.ndarray:
        """The probability of words alone by their counts."""
        d = np.where(counts <= K, self.d[np.minimum(counts, K)], 1.0)
        return np.where(counts > 0, d * counts / self.whole, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))

    def salts(self, contexts: np.ndarray) -> np.ndarray:
        """Over how many parts a context may be dealt: four times its share of them."""
        n = np.zeros(len(contexts), np.int64)
        some = contexts < RARE
        n[some] = self.counts[contexts[some].astype(np.int64)]
        n[contexts == self.begin] = self.ends
        n[contexts == self.alone] = self.tokens
        return np.maximum(1, np.ceil(4.0 * self.parts * n / max(1, self.tokens))).astype(np.uint64)

    def part(self, contexts: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return (shuffled(shuffled(contexts) + salt) % np.uint64(self.parts)).astype(np.int64)

    def parts_of(self, contexts: np.ndarray, words_: np.ndarray) -> np.ndarray:
        return self.part(contexts, shuffled(words_ + np.uint64(1)) % self.salts(contexts))


class Ids(Numbers):
    """The numbers of words by a head, remembered."""

    def __init__(self, head: Head):
        super().__init__()
        self.rank = dict(zip(head.hashes.tolist(), head.rank.tolist(), strict=True))

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = number = self.rank.get(h, h | 1 << 63)
        return number


@dataclass
class Model:
    """``grams`` and ``contexts`` (``u, whole, alpha``) as tables, ``head`` with the bounded rest."""

    head: Head
    grams: DataFrame
    contexts: DataFrame


class Block:
    """Tokens of some texts, each beside the one before, and their distinct pairs by part."""

    def __init__(self, head: Head, ids: np.ndarray, before: np.ndarray, places: bool = False):
        rare = np.unique(np.concatenate([x[x >= RARE] for x in (ids, before)]))
        many = len(head.counts)

        def code(x):
            out, high = x.astype(np.int64), x >= RARE
            out[high] = many + np.searchsorted(rare, x[high])
            return out

        self.token, names = code(ids), np.concatenate([np.arange(many, dtype=np.uint64), rare])
        keys = code(before) << 32 | self.token
        if places:  # which distinct pair each token ends
            keys, self.pair = np.unique(keys, return_inverse=True)
        else:
            keys, self.times = np.unique(keys, return_counts=True)
        u, w = keys >> 32, keys & 0xFFFFFFFF
        #: Tokens that the head lacks are asked for alone, after the pairs.
        self.alone = np.unique(self.token[self.token >= many])
        self.pairs = len(u)
        self.w = np.concatenate([w, self.alone])
        u_ids = np.concatenate([names[u], np.full(len(self.alone), head.alone)])
        w_ids = names[self.w]
        part = head.parts_of(u_ids, w_ids)
        order = np.argsort(part.astype(np.uint16) if head.parts <= 2**16 else part, kind="stable")  # they are sorted by context and word
        cut = np.flatnonzero(np.diff(part[order])) + 1
        #: By part: its number, which distinct pairs it holds, their contexts and words.
        self.by_part = [(int(part[x[0]]), x, u_ids[x], w_ids[x]) for x in np.split(order, cut)] if len(order) else []
        self.codes = many + len(rare)


def _runs(u: np.ndarray) -> np.ndarray:
    """Where runs of equal contexts begin."""
    return np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.empty(0, int)


def _blocks(batches, number, block: int):
    """Texts of batches ``row, k, t`` as blocks: rows, keys, tokens of each, their numbers and what stands before each."""
    rows, keys, sizes, ids, before, held = [], [], [], [], [], 0
    end, begin = number.of([END]), number.of([BEGIN])

    def put(x, last, row, key):
        if rows and rows[-1] == row:
            sizes[-1] += len(x)
        else:
            rows.append(row)
            keys.append(key)
            sizes.append(len(x))
        ids.append(x)
        before.append(np.concatenate([last, x[:-1]]))
        return len(x)

    for batch in batches:
        for row, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            last, found = begin, []
            for found in words(text.as_py(), BLANKS):
                if held + len(found) > block and held:
                    yield rows, keys, sizes, np.concatenate(ids), np.concatenate(before)
                    rows, keys, sizes, ids, before, held = [], [], [], [], [], 0
                if found:
                    x = number.of(found)
                    held += put(x, last, row, key)
                    last = x[-1:]
            held += put(end, last, row, key)
            if held > block:
                yield rows, keys, sizes, np.concatenate(ids), np.concatenate(before)
                rows, keys, sizes, ids, before, held = [], [], [], [], [], 0
                release()
    if held:
        yield rows, keys, sizes, np.concatenate(ids), np.concatenate(before)


def _word_counts(docs: DataFrame, text: str) -> DataFrame:
    """``w, n``: how often each word's hash, and that of the end, occurs."""

    def run(batches):
        count: Counter = Counter()
        number, ends = Numbers(), 0

        def flush():
            found = list(count)
            return pa.RecordBatch.from_arrays([pa.array(number.of(found).view(np.int64)), pa.array(list(count.values()), pa.int64())], ["w", "n"])

        for batch in batches:
            ends += batch.num_rows
            for t in batch.column(0):
                for found in words(t.as_py(), BLANKS):
                    count.update(found)
                    if len(count) > FLUSH_WORDS:
                        yield flush()
                        count.clear()
                        number.clear()
            release()
        count[END] = ends
        yield flush()

    return docs.select(text).mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).filter("n > 0")


def train(docs: DataFrame, text: str = "text", head_words: int = HEAD_WORDS, part: int = PART, block: int = BLOCK) -> Model:
    """A model of all texts."""
    spark = docs.sparkSession
    alone = saved(_word_counts(docs, text), "words")
    counted = alone.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("v"), *[F.count(F.when(F.col("n") == r, 1)).alias(f"n{r}") for r in range(1, K + 2)]).first()
    ends = alone.filter(F.col("w") == int(Numbers().of([END]).view(np.int64)[0])).agg(F.max("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counted.tokens // part))
    # the most frequent words: as many whole classes of counts as fit
    size = F.floor(F.log2("n") * 16)
    cut, held = math.inf, 0
    for r in alone.groupBy(size.alias("size")).agg(F.count("*").alias("many")).orderBy(F.desc("size")).collect():  # at most 64 * 16
        held += r.many
        if held > head_words:
            break
        cut = r["size"]
    most = alone.filter(size >= cut if cut < math.inf else F.lit(False)).toArrow()  # at most head_words
    head = Head(most.column("w").to_numpy().view(np.uint64), most.column("n").to_numpy(), counted.tokens, counted.v, ends, [counted[f"n{r}"] for r in range(1, K + 2)], parts)
    shared = spark.sparkContext.broadcast(head)  # at most head_words

    def count(batches):
        head = shared.value
        number = Ids(head)
        for _, _, _, ids, before in _blocks(batches, number, block):
            b = Block(head, ids, before)
            n = np.concatenate([b.times, np.bincount(b.token, minlength=b.codes)[b.alone]])
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*[(p, GRAMS, 0, pack_sorted(u), pack(w), pack(n[x])) for p, x, u, w in b.by_part], strict=True), _KINDS, strict=True)], _NAMES)
            release()

    def merge(group):
        u, w, n = (np.concatenate([f(x) for x in group.column(c).to_pylist()]) for c, f in (("a", unpack_sorted), ("b", unpack), ("c", unpack)))
        order = np.lexsort((w, u))
        u, w, n = u[order], w[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])]))
        release()
        return pa.table([pa.array([x], kind) for x, kind in zip((group.column("part")[0].as_py(), GRAMS, 0, pack_sorted(u[first]), pack(w[first]), pack(np.add.reduceat(n, first))), _KINDS, strict=True)], names=_NAMES)

    rows = docs.select(F.lit(0).alias("row"), F.lit(0).alias("k"), F.col(text).alias("t"))
    grams = saved(rows.mapInArrow(count, PACKED).groupBy("part").applyInArrow(merge, PACKED), "grams")
    head.pair_d = np.array(discounts(_counts_of_counts(grams, head)))
    return Model(head, grams, saved(_contexts(grams, alone, head), "contexts"))


_KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
_NAMES = ["part", "kind", "block", "a", "b", "c"]


def _counts_of_counts(grams: DataFrame, head: Head) -> list[int]:
    def run(batches):
        total = np.zeros(K + 2, np.int64)
        for batch in batches:
            for a, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = unpack(c)[unpack_sorted(a) != head.alone].astype(np.int64)
                total += np.bincount(np.minimum(n, K + 2), minlength=K + 3)[: K + 2]
        yield pa.RecordBatch.from_arrays([pa.array(range(1, K + 2)), pa.array(total[1:])], ["r", "n"])

    out = [0] * (K + 1)
    for r in grams.select("a", "c").mapInArrow(run, "r long, n long").groupBy("r").agg(F.sum("n").alias("n")).collect():  # K + 1
        out[r.r - 1] = r.n
    return out


def _contexts(grams: DataFrame, alone: DataFrame, head: Head) -> DataFrame:
    """``u, whole, alpha`` of every context."""
    shared = grams.sparkSession.sparkContext.broadcast(head)

    def sums(batches):
        head = shared.value
        for batch in batches:
            for a, b, c in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                u, w, n = unpack_sorted(a), unpack(b), unpack(c).astype(np.int64)
                pairs = u != head.alone
                u, w, n = u[pairs], w[pairs], n[pairs]
                at, known = _runs(u), w < RARE
                low = np.zeros(len(w))
                low[known] = head.alone_p(head.counts[w[known].astype(np.int64)])
                left = np.where(n <= K, 1 - head.pair_d[np.minimum(n, K)], 0.0) * n
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u[at].view(np.int64)), *[pa.array(np.add.reduceat(x, at)) for x in (n, left, low)]], ["u", "whole", "left", "low"])

    def rare(batches):
        head = shared.value
        for batch in batches:
            for a, b in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                u, w = unpack_sorted(a), unpack(b)
                x = (u != head.alone) & (w >= RARE)
                yield pa.RecordBatch.from_arrays([pa.array(u[x].view(np.int64)), pa.array((w[x] & ~RARE).view(np.int64))], ["u", "w"])

    d = F.element_at(F.array(*[F.lit(float(x)) for x in head.d[1:]]), F.least("n", F.lit(K)).cast("int"))
    p = F.when(F.col("n") <= K, d).otherwise(1.0) * F.col("n") / head.whole
    low = grams.select("a", "b").mapInArrow(rare, "u long, w long").join(alone.select(F.col("w").bitwiseAND(F.lit(2**63 - 1)).alias("w"), "n"), "w")
    low = low.groupBy("u").agg(F.sum(p).alias("low")).select("u", F.lit(0).cast("long").alias("whole"), F.lit(0.0).alias("left"), "low")
    parts = grams.select("a", "b", "c").mapInArrow(sums, "u long, whole long, left double, low double").unionByName(low)
    whole = parts.groupBy("u").agg(F.sum("whole").alias("whole"), F.sum("left").alias("left"), F.sum("low").alias("low"))
    none = F.col("left") <= 0
    return whole.select("u", (F.col("whole") + none.cast("long")).alias("whole"), (F.when(none, 1.0).otherwise(F.col("left")) / (F.col("whole") + none.cast("long")) / (1 - F.col("low"))).alias("alpha"))


def _dealt(contexts: DataFrame, head: Head) -> DataFrame:
    """The contexts by part, in packed rows; those dealt over several parts stand in each."""
    shared = contexts.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        head = shared.value
        for batch in batches:
            u, whole, alpha = (np.ascontiguousarray(c.to_numpy()).view(np.uint64) for c in batch.columns)
            salts = head.salts(u).astype(np.int64)
            row = np.repeat(np.arange(len(u)), salts)
            salt = np.arange(len(row)) - np.repeat(np.cumsum(salts) - salts, salts)
            both = np.unique(head.part(u[row], salt.astype(np.uint64)) << 32 | row)
            part, row = both >> 32, both & 0xFFFFFFFF
            found = [(int(part[x[0]]), CONTEXTS, 0, pack(u[row[x]]), pack(whole[row[x]]), alpha[row[x]].tobytes()) for x in np.split(np.arange(len(row)), np.flatnonzero(np.diff(part)) + 1)] if len(row) else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), _KINDS, strict=True)], _NAMES)

    return contexts.select("u", "whole", "alpha").mapInArrow(run, PACKED)


def _answer(group):
    """Counts of the pairs that blocks ask for, and figures of their contexts, of one part."""
    kind, block = group.column("kind").to_numpy(), group.column("block").to_pylist()
    a, b, c = (group.column(x) for x in "abc")
    of = lambda k: np.flatnonzero(kind == k).tolist()
    join = lambda rows, f, column, kind=np.uint64: np.concatenate([f(column[i].as_py()) for i in rows]) if rows else np.empty(0, kind)
    u, w, n = join(of(GRAMS), unpack_sorted, a), join(of(GRAMS), unpack, b), join(of(GRAMS), unpack, c)
    both = shuffled(shuffled(u) + w)
    order = np.argsort(both)
    both, u, w, n = both[order], u[order], w[order], n[order]
    cu, whole, alpha = join(of(CONTEXTS), unpack, a), join(of(CONTEXTS), unpack, b), join(of(CONTEXTS), np.frombuffer, c, float)
    order = np.argsort(cu)
    cu, whole, alpha = cu[order], whole[order], alpha[order]
    out = []
    for i in of(ASKED):
        qu, qw = unpack_sorted(a[i].as_py()), unpack(b[i].as_py())
        q = shuffled(shuffled(qu) + qw)
        at, found = np.searchsorted(both, q), np.zeros(len(q), np.uint64)
        open_ = np.arange(len(q))
        while len(open_):  # once, but for pairs that share a hash
            open_ = open_[at[open_] < len(both)]
            open_ = open_[both[at[open_]] == q[open_]]
            x = at[open_]
            hit = (u[x] == qu[open_]) & (w[x] == qw[open_])
            found[open_[hit]] = n[x[hit]]
            open_ = open_[~hit]
            at[open_] += 1
        starts = _runs(qu)
        some = qu[starts]
        at = np.minimum(np.searchsorted(cu, some), max(0, len(cu) - 1))
        known = cu[at] == some if len(cu) else np.zeros(len(some), bool)
        missing = np.add.reduceat((found == 0).astype(np.int64), starts) > 0
        w_out, a_out = np.zeros(len(some), np.uint64), np.where(missing, 1.0, 0.0)
        w_out[known] = whole[at[known]]
        a_out[known & missing] = alpha[at[known & missing]]
        out.append((block[i], pack(found), pack(w_out), zstandard.compress(a_out.tobytes(), 1), group.column("part")[i].as_py()))
    release()
    return pa.table([pa.array([r[x] for r in out], kind) for x, kind in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()))], names=["block", "counts", "wholes", "alphas", "part"])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score`` of every row; scores are log10 probabilities."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.head)
    kind = docs.schema[key].dataType.simpleString()

    def tokenise(batches):
        head = shared.value
        number = Ids(head)
        for rows, keys, sizes, ids, before in _blocks(batches, number, block):
            # one row a block; tokens beyond the head as places in a list
            rare = np.unique(np.concatenate([ids[ids >= RARE], before[:1]]))
            code = ids.copy()
            high = ids >= RARE
            code[high] = np.searchsorted(rare, ids[high]).astype(np.uint64) + np.uint64(len(head.counts))
            row_type, key_type = batch_types
            yield pa.RecordBatch.from_arrays([pa.array([rows], pa.list_(row_type)), pa.array([keys], pa.list_(key_type)), pa.array([sizes], pa.list_(pa.int32())), pa.array([before[:1].tobytes()]), pa.array([pack_sorted(rare)]), pa.array([pack(code)])], ["rows", "keys", "sizes", "before", "rare", "tokens"])
            release()

    batch_types = (pa.int64(), _arrow(docs, key))
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), F.col(text).alias("t"))
    blocks = given.mapInArrow(tokenise, f"rows array<long>, keys array<{kind}>, sizes array<int>, before binary, rare binary, tokens binary")
    blocks = saved(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")

    def ask(batches):
        head = shared.value
        for batch in batches:
            for number, row in zip(batch.column("block").to_pylist(), batch.to_pylist(), strict=True):
                b = Block(head, *_restored(head, row))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*[(p, ASKED, number, pack_sorted(u), pack(w), b"") for p, _, u, w in b.by_part], strict=True), _KINDS, strict=True)], _NAMES)
                release()

    asked = blocks.select("block", "rows", "sizes", "before", "rare", "tokens").mapInArrow(ask, PACKED)
    both = asked.unionByName(model.grams).unionByName(_dealt(model.contexts, model.head))
    answers = both.groupBy("part").applyInArrow(_answer, "block long, counts binary, wholes binary, alphas binary, part int")

    def judge(one, found):
        head = shared.value
        row = one.to_pylist()[0]
        ids, before = _restored(head, row)
        b = Block(head, ids, before, places=True)
        replies = {r["part"]: r for r in found.to_pylist()}
        counts, whole, alpha = np.zeros(len(b.w), np.int64), np.ones(len(b.w)), np.ones(len(b.w))
        for p, x, u, _ in b.by_part:
            r, starts = replies[p], _runs(u)
            sizes = np.diff([*starts, len(u)])
            counts[x] = unpack(r["counts"])
            whole[x] = np.repeat(unpack(r["wholes"]).astype(float), sizes)
            alpha[x] = np.repeat(np.frombuffer(zstandard.decompress(r["alphas"])), sizes)
        alone = np.zeros(b.codes, np.int64)
        alone[: len(head.counts)] = head.counts
        alone[b.alone] = counts[b.pairs :]
        c, whole, alpha, w = counts[: b.pairs], whole[: b.pairs], alpha[: b.pairs], b.w[: b.pairs]
        seen = c > 0
        d = np.where(c <= K, head.pair_d[np.minimum(c, K)], 1.0)
        p = np.where(seen, d * c / np.where(seen, whole, 1.0), alpha * head.alone_p(alone[w]))
        own = alone[b.token]
        of = np.repeat(np.arange(len(row["sizes"])), row["sizes"])
        many = len(row["sizes"])
        sums = [pa.array(np.bincount(of, x, many)) for x in (head.base(own), np.log10(p)[b.pair])]
        known = np.bincount(of, own > 0, many).astype(np.int64)
        release()
        return pa.table([pa.array(row["rows"], pa.int64()), pa.array(row["keys"], batch_types[1]), pa.array(row["sizes"], pa.int64()), pa.array(known), *sums], names=["row", "k", "n_tokens", "n_known", "base_score", "score"])

    judged = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, f"row long, k {kind}, n_tokens long, n_known long, base_score double, score double")
    names = ("n_tokens", "n_known", "base_score", "score")
    whole = judged.groupBy("row").agg(F.first("k").alias(key), *[F.sum(c).alias(c) for c in names])  # texts cut over blocks
    return whole.select(key, "n_tokens", "n_known", F.lit(model.head.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _arrow(docs: DataFrame, key: str):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[key].dataType)


def _restored(head: Head, row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a block's tokens and of those before them."""
    names = np.concatenate([np.arange(len(head.counts), dtype=np.uint64), unpack_sorted(row["rare"])])
    ids = names[unpack(row["tokens"]).astype(np.int64)]
    before = np.concatenate([np.frombuffer(row["before"], np.uint64), ids[:-1]])
    before[np.cumsum(row["sizes"][:-1], dtype=np.int64)] = head.begin  # only a block's first text may have begun before it
    return ids, before
