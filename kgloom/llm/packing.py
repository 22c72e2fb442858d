"""Best-fit packing of token sequences by hierarchical residual packing.

1. Each partition packs its pieces best-fit, longest first.
2. Bins that are full but for ``slack`` tokens are emitted.
3. The underfull bins become items of fewer partitions (a merge tree of fan-in
   ``FAN_IN``, at most about ``TASK_ITEMS`` items each), dealt anew, and are packed again,
   until one partition is left, or a round closes or merges less than the share
   ``PROGRESS`` of its bins; the bins left then are emitted as they are.

Every round is written to the shared folder, so that bins do not change when a
task is repeated.  A task holds at most about ``TASK_ITEMS`` items; nothing is
gathered in the driver but counts.

Defined results: null and empty texts give a piece that holds the end token
alone; repeated rows and null keys are packed like others; ties in length are
packed in the order of key, piece and checksum.  Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _UNSURE, PairIndexBPE, chunks, default_vocabulary
from .common import release, saved

TASK_ITEMS = 50_000
FAN_IN = 8
#: A round emits the bins that lack at most this share of a sequence.
SLACK = 1 / 128
#: A round that leaves more than all but this share of its bins is the last.
PROGRESS = 0.01


class FastIds:
    """Ids as the tokenizers library gives them, by a faster encoder where both agree.

    One vocabulary is held: the library's is loaded only when a text needs it.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        bpe = PairIndexBPE(path)
        self.path, self.library, self.fast = path, None, None
        if [m[2] for m in bpe.merged] == sorted(m[2] for m in bpe.merged):  # ids are in the order of the merges
            added = set(bpe.added.values())
            plain = {b: i for i, b in enumerate(bpe.bytes_of) if i not in added}
            self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=plain, special_tokens=bpe.added)

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or _UNSURE.search(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all")


_fast: dict[str, FastIds] = {}


def pieces(docs: DataFrame, length: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, piece, start, length, ids_crc32``: documents as ids plus ``end_id``, cut so that only the first piece is short."""
    path = path or default_vocabulary()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        if path not in _fast:
            _fast[path] = FastIds(path)
        for batch in batches:
            for at, part in chunks(batch.column(1), 2_000_000):
                rows, cols = [], [[], [], [], []]
                for n, t in enumerate(part):
                    ids = np.array([*(_fast[path](t) if t else ()), end_id], "<u4")
                    first = (len(ids) - 1) % length + 1
                    cuts = [0, *range(first, len(ids) + 1, length)]
                    for p, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(at + n)
                        for c, v in zip(cols, (p, x, y - x, zlib.crc32(ids[x:y].tobytes())), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["k", "piece", "start", "length", "ids_crc32"])
            release()

    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, piece int, start long, length long, ids_crc32 long")
    return out.withColumnRenamed("k", key)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and its place in it; the items come longest first.

    Open bins stand on a stack for each residual, and the bits of one integer
    tell which stacks hold any, so the tightest bin is found at once.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    held, bins, places, count = 0, np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for n, size in enumerate(sizes.tolist()):
        if fits := held >> size:
            residual = size + ((fits & -fits).bit_length() - 1)
            stack = open_bins[residual]
            b = stack.pop()
            if not stack:
                held ^= 1 << residual
        else:
            b, residual, count = count, capacity, count + 1
        bins[n], places[n] = b, capacity - residual
        left = residual - size
        if left:
            if not open_bins[left]:
                held |= 1 << left
            open_bins[left].append(b)
    return bins, places


def _pack(items: DataFrame, number: int, capacity: int, slack: float) -> DataFrame:
    """One round: ``sequence_id, size, done, members`` of the bins of each partition."""

    def run(batches):
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        sizes = table["size"].to_numpy()
        members = table["members"].combine_chunks()
        members = members if isinstance(members, pa.ListArray) else members.chunk(0)
        first = members.flatten()
        offsets = np.asarray(members.offsets) - members.offsets[0].as_py()
        heads = first.take(pa.array(offsets[:-1]))
        lead = [heads.field(f).to_numpy(zero_copy_only=False) for f in ("piece", "ids_crc32")]
        keys = heads.field("k")
        ranked = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False) if not pa.types.is_integer(keys.type) else np.nan_to_num(keys.to_numpy(zero_copy_only=False))
        order = np.lexsort((lead[1], lead[0], ranked, -sizes))
        bins, places = best_fit(sizes[order], capacity)
        by_bin = np.argsort(bins, kind="stable")
        order, bins, places = order[by_bin], bins[by_bin], places[by_bin]
        counts = np.diff(offsets)[order]
        flat = members.take(pa.array(order)).flatten()
        moved = pc_add(flat.field("offset"), np.repeat(places, counts))
        fields = [moved if f.name == "offset" else flat.field(f.name) for f in flat.type]
        starts = np.flatnonzero(np.diff(bins, prepend=-1))
        totals = np.add.reduceat(sizes[order], starts)
        ends = np.concatenate([[0], np.cumsum(counts)])[[*starts, len(order)]]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(flat.type)))
        base = (number << 54) + (TaskContext.get().partitionId() << 28)
        out = pa.table([pa.array(base + np.arange(len(starts))), pa.array(totals), pa.array(totals >= capacity - slack), lists], ["sequence_id", "size", "done", "members"])
        yield from out.to_batches(max_chunksize=10_000)

    kind = items.schema["members"].dataType.simpleString()
    return items.select("size", "members").mapInArrow(run, f"sequence_id long, size long, done boolean, members {kind}")


def pc_add(column: pa.Array, more: np.ndarray) -> pa.Array:
    return pa.array(column.to_numpy(zero_copy_only=False) + more, pa.int64())


def pack(cut: DataFrame, capacity: int = 1024, key: str = "doc_id", task_items: int = TASK_ITEMS, slack: float = SLACK) -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset``; ``cut`` is as of :func:`pieces`.

    Pieces that fill a sequence have it for themselves.  Needs no key that is
    unique.  Lengths are from 1 to ``capacity``.
    """
    cut = saved(cut, "pieces")
    columns = [F.col(key).alias("k"), "piece", "start", "length", "ids_crc32"]
    whole = cut.filter(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = cut.filter(F.col("length") < capacity).select(F.col("length").alias("size"), F.array(F.struct(*columns, F.lit(0).cast("long").alias("offset"))).alias("members"))
    left, parts, number, out = items.count(), None, 0, whole
    while left:
        least = -(-left // task_items)
        parts = least if parts is None else max(least, -(-parts // FAN_IN))
        packed = saved(_pack(items.repartition(parts), number, capacity, capacity if parts == 1 else capacity * slack), f"packed{number}")
        items = packed.filter("not done")
        before, left, number = left, items.count(), number + 1
        still = left > (1 - PROGRESS) * before  # a round that merges next to nothing: other rounds would not either
        out = out.unionByName((packed if still else packed.filter("done")).select("sequence_id", F.explode("members").alias("m")).select("m.*", "sequence_id"))
        left = 0 if still else left
    return out.withColumnRenamed("k", key)


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Tokenise, cut and pack; see :func:`pieces` and :func:`pack`."""
    return pack(pieces(docs, capacity, end_id, key, text, path), capacity, key)
