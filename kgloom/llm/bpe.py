"""BPE encoding and decoding with a pair occurrence index.

``encode`` and ``decode`` are DataFrame operators; ``encode_digests`` is both
in one pass, for comparing a corpus with another encoder.  Each Arrow batch of
a partition is handled together: its distinct pre-tokens that are not cached
yet are laid out in one symbol list, an index maps every adjacent pair to all
its positions, and the ranks that occur are applied in ascending order.  A merge
can only create pairs of a higher rank, so a rank is complete when its turn
comes; the affected position lists are updated as it goes.

Defined results: null text counts as empty and has no ids; repeated rows, ties
and null keys pass through; columns of the input other than the key and the text
are not read.  Memory is bounded by an Arrow batch plus a cache of
``CACHE_WORDS`` pre-tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A worker forgets its cached pre-tokens beyond so many.
CACHE_WORDS = 800_000
#: Characters on whose class regex libraries of different Unicode versions may
#: differ lie in these ranges only; texts with them are split by the library.
_UNSURE = re.compile("[԰-᷿⁰-\U0010ffff]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in kept}
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + len(names) - len(kept))
    return [names[b] for b in range(256)]


class PairIndexBPE:
    """A byte-level BPE vocabulary with the merge loop of this module."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        to_byte = {c: b for b, c in enumerate(alphabet)}
        self.path = path
        self.byte_id = np.array([vocab[c] for c in alphabet])
        #: The pairs a, b as a * 65536 + b, sorted, with their ranks; a, b and what they become by rank.
        ranks: dict[int, int] = {}
        self.merged: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks.setdefault(vocab[a] * 65536 + vocab[b], rank)
            self.merged.append((vocab[a], vocab[b], vocab[a + b]))
        self.pairs = np.array(sorted(ranks), np.int64)
        self.pair_ranks = np.array([ranks[x] for x in self.pairs.tolist()], np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.specials = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.cache: dict[str, tuple[int, ...]] = {}
        self._library = None

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of a text; added tokens come out as themselves."""
        if self.specials is None or not (found := list(self.specials.finditer(text))):
            return self._words(text)
        out, at = [], 0
        for m in found:
            out += self._words(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._words(text[at:])

    def _words(self, text: str) -> list[str]:
        if _UNSURE.search(text):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.path).pre_tokenizer
            return [text[i:j] for _, (i, j) in self._library.pre_tokenize_str(text)]
        return self.split.findall(text)

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Merge all words at once; see the module's text."""
        data = [w.encode("utf-8") for w in words]
        sizes = np.array([len(d) + 1 for d in data])
        ends = np.cumsum(sizes)  # where the -1 after each word stands; one stands before the first
        symbols = np.full(int(ends[-1]) + 1, -1, np.int64)
        inner = np.ones(len(symbols), bool)
        inner[0], inner[ends] = False, False
        symbols[inner] = self.byte_id[np.frombuffer(b"".join(data), np.uint8)]
        after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        where: dict[int, list[np.ndarray]] = {}
        heap = self._index(where, symbols[:-1] * 65536 + symbols[1:], np.arange(len(symbols) - 1))
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            a, b, merged = self.merged[rank]
            i = where.pop(rank)
            i = i[0] if len(i) == 1 else np.unique(np.concatenate(i))
            j = after[i]
            live = (symbols[i] == a) & (symbols[j] == b)  # else an earlier merge has taken one of the two
            i, j = i[live], j[live]
            if a == b and len(i) > 1:  # in a run, from the left
                taken, keep = -1, []
                for n, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
                    if x != taken:
                        keep.append(n)
                        taken = y
                i, j = i[keep], j[keep]
            if not len(i):
                continue
            k = after[j]
            symbols[i], symbols[j], after[i], before[k] = merged, -2, k, i
            h = before[i]
            for new in self._index(where, np.concatenate([symbols[h] * 65536 + merged, merged * 65536 + symbols[k]]), np.concatenate([h, i])):
                heapq.heappush(heap, new)
        ids, bounds = [], np.flatnonzero((kept := symbols[symbols != -2]) == -1).tolist()
        flat = kept.tolist()
        for x, y in zip(bounds, bounds[1:], strict=False):
            ids.append(tuple(flat[x + 1 : y]))
        return ids

    def _index(self, where: dict[int, list[np.ndarray]], pairs: np.ndarray, places: np.ndarray) -> list[int]:
        """File the places under the ranks of their pairs; the ranks that are new in ``where``."""
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        known = self.pairs[at] == pairs
        ranks, places = self.pair_ranks[at[known]], places[known]
        if not len(ranks):
            return []
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        starts, stops = [0, *cuts.tolist()], [*cuts.tolist(), len(ranks)]
        fresh = []
        for rank, x, y in zip(ranks[starts].tolist(), starts, stops, strict=True):
            if rank in where:
                where[rank].append(places[x:y])
            else:
                where[rank] = [places[x:y]]
                fresh.append(rank)
        return fresh

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.pretokens(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        if not self.cache:
            self.cache.update({t: (i,) for t, i in self.added.items()})
        cache = self.cache
        fresh = list({w for words in split for w in words}.difference(cache))
        for k in range(0, len(fresh), 200_000):
            part = fresh[k : k + 200_000]
            cache.update(zip(part, self.encode_words(part), strict=True))
        return [[i for w in words for i in cache[w]] for words in split]

    def decode(self, ids) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become U+FFFD."""
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


_loaded: dict[str, PairIndexBPE] = {}


def vocabulary(path: str) -> PairIndexBPE:
    """The vocabulary at ``path``, once for a worker process."""
    if path not in _loaded:
        _loaded[path] = PairIndexBPE(path)
    return _loaded[path]


def chunks(column: pa.Array, most: int = 8_000_000) -> Iterator[tuple[int, list]]:
    """Slices of a text column of about ``most`` bytes, with where they start."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, column.slice(at, end - at).to_pylist()
        at = end


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """All columns of ``docs`` and the token ids of ``text`` as ``out`` (replaced if it exists)."""
    path = path or default_vocabulary()

    @F.pandas_udf("array<int>")
    def ids(series):
        import pandas as pd

        return pd.Series([np.array(x, "int32") for _, part in chunks(pa.array(series, pa.string())) for x in vocabulary(path).encode_batch(part)], dtype=object)

    return docs.withColumn(out, ids(F.col(text)))


def decode(docs: DataFrame, ids: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    """All columns of ``docs`` and the text of ``ids`` as ``out``; null ids give an empty text."""
    path = path or default_vocabulary()

    @F.pandas_udf("string")
    def text(series):
        import pandas as pd

        return pd.Series([vocabulary(path).decode([] if x is None else x) for x in series], dtype=object)

    return docs.withColumn(out, text(F.col(ids)))


def encode_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of every row, in one pass without a shuffle."""
    path = path or default_vocabulary()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            for at, part in chunks(batch.column(1)):
                rows = [[], [], []]
                for ids in bpe.encode_batch(part):
                    rows[0].append(len(ids))
                    rows[1].append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                    rows[2].append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], ["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("k", key)
