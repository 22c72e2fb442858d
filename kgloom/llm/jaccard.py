"""Similarity join of documents by the Jaccard index of word n-grams, with PartEnum signatures.

Sets whose index is at least t differ in at most ``k = (1 - t) / (1 + t) * (|A| +
|B|)`` elements.  For each band of sizes (one band a power of two; a set near the
bottom of its band signs in the one below too, so that every pair that can be similar
meets in some band) a hash partitions the domain of shingles in two levels: into
groups, and each group into three parts.  A set has a signature for every group
and every subset of two of its parts: the digest of what it holds there.  At most
k / 2 groups have two differences or more; in any other, one part has all the
differences, and the two sets share the signature of the other two parts.

A signature without an element says nothing, so a set is sure to meet if more than
k / 2 of its groups have elements in two parts at least.  This is counted for each
set.  Sets that fail it, some in a thousand, sign by another hash of the domain as
well, and those that fail both by the finest partition, in which every shingle is
a part; of two similar sets that fail, both sign there.

Subsets of frequent shingles only are not signed by sets that have a rare shingle
in two parts of more than k / 2 groups, by the same argument; so documents that
share a passage and nothing else do not meet.  Which shingles are frequent is
learned from a bounded sample and changes the cost only.

Equal sets are one node.  Nodes that share a signature are joined to a star, never
to all pairs, and every task contracts its stars to a forest.  The trees are
clusters; similar nodes are always in one.  Each cluster is then compared in
blocks of its sets, each pair of blocks in a task of its own, by the exact sizes
of their intersections (64-bit digests of shingles; a set's own digest has 64 bits
as well).  A task returns how many links each node has and a spanning forest of
them.  So no link is lost, every link is counted, and no list of pairs is made.

Chains of unrelated sets that share a signature by a common passage make clusters that grow
faster than the input.  A cluster whose comparison would be large is therefore cut first:
its shingles are counted in it, a set's prefix are its rarest ones, one more than it may lack
in a similar set, and only sets that share a shingle of both prefixes stay together.  Of two
similar sets the rarest common shingle is in both prefixes, so no link is cut.

Defined results: texts that are null or without a word have 0 shingles and link
with nothing; fewer words than a shingle has make one shingle of all; rows that
share a key are rows of their own; null keys do not count for the least key and
take the component's id; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import chunks
from .common import release, saved, slices
from .components import components, forest
from .dedup import filter_of, split

#: Documents in the sample for frequent shingles, and how often a shingle is then frequent.
SAMPLE_DOCS = 10_000
SAMPLE_COUNT = 5
FREQUENT_BITS = 2**25
#: Bytes of the texts whose sets a task makes at a time.
SLICE = 500_000
#: Signatures that a task collects before it looks for equal ones among them.
FLUSH = 500_000
#: The signatures' range is cut into a part for so many elements of sets, and at least so many parts.
PART_ELEMENTS, LEAST_PARTS = 3_000_000, 32
#: A task takes a part's signatures in so many turns.
TURNS = 8
#: A cluster has about so many blocks, as far as these bounds of the elements in a block allow.
BLOCKS, LEAST_BLOCK, MOST_BLOCK = 8, 50_000, 800_000
#: Clusters of more elements times sets than this are cut by their rarest shingles before they are compared.
CUT_WORK = 10_000_000
#: Elements of the blocks that a task is given, about.
TASK_ELEMENTS = 400_000
#: Links that a task holds before it contracts them.
HELD_LINKS = 500_000

_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32
_is_word = np.ones(256, bool)
_is_word[[0x20, *range(0x09, 0x0E)]] = False
_powers = np.ones(1, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and digests of the distinct shingles of each text, sorted by both."""
    global _powers
    data = [(t or "").encode("utf-8") for t in texts]
    sizes = np.array([len(d) + 1 for d in data])
    raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    word = _is_word[raw]
    edges = np.diff(word.astype(np.int8), prepend=0)
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    lengths = stops - starts
    if (longest := int(lengths.max())) > len(_powers):
        _powers = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(2 * longest, _BASE))])
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    letters = _low[raw[word]].astype(np.uint64) + np.uint64(1)
    words = mix(np.add.reduceat(letters * _powers[inside], np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))
    doc = np.searchsorted(np.cumsum(sizes), starts, "right")
    per_doc = np.bincount(doc, minlength=len(texts))
    full = np.flatnonzero(doc[: max(0, len(doc) - width + 1)] == doc[width - 1 :]) if len(doc) >= width else np.empty(0, np.int64)
    digest = np.zeros(len(full), np.uint64)
    for n in range(width):
        digest = mix(digest + words[full + n] + np.uint64(n + 1))
    short = np.flatnonzero((per_doc > 0) & (per_doc < width))
    first = (np.cumsum(per_doc) - per_doc)[short]
    whole = np.zeros(len(short), np.uint64)
    for n in range(width - 1):
        on = per_doc[short] > n
        whole[on] = mix(whole[on] + words[first[on] + n] + np.uint64(n + 1))
    whole = mix(whole + per_doc[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    of = np.concatenate([doc[full], short])
    digest = np.concatenate([digest, whole])
    order = np.lexsort((digest, of))
    of, digest = of[order], digest[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (digest[1:] != digest[:-1])
    return of[new], digest[new]


def sets_of(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`shingle_sets`, of many texts: made slice by slice, as making them takes some thirty times a text's bytes."""
    docs, digests, at, end = [], [], 0, 0
    while at < len(texts):
        size = 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
            size += len(texts[end])
            end += 1
        doc, digest = shingle_sets(texts[at:end], width)
        docs.append(doc + at)
        digests.append(digest)
        at = end
    return np.concatenate(docs), np.concatenate(digests)


def set_digests(doc: np.ndarray, digest: np.ndarray, count: int) -> np.ndarray:
    """A digest of each document's set, not of its order."""
    out = np.bincount(doc, minlength=count).astype(np.uint64)
    np.add.at(out, doc, mix(digest + np.uint64(0xA0761D6478BD642F)))
    return mix(out)


class Bands:
    """Numbers of groups and possible differences by size, for an index of ``percent`` / 100."""

    def __init__(self, percent: int):
        self.percent = percent

    def differences(self, sizes: np.ndarray, tops: np.ndarray) -> np.ndarray:
        """The most elements in which a set and a similar one differ that meet in a band below ``tops``, at least one of them of the band."""
        partner = np.where(sizes < tops, 100 * sizes // self.percent, tops - 1)
        return (100 - self.percent) * (sizes + partner) // (100 + self.percent)

    def groups(self, band: int) -> int:
        """Groups in a band: more than can have two differences, and some more, as chance leaves groups without elements."""
        top = np.int64(2 ** (band + 1))
        need = int(self.differences(top - 1, top)) // 2 + 1
        return need + need // 12 + 1


def signatures(doc: np.ndarray, digest: np.ndarray, count: int, percent: int, frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and signatures; ``frequent``: bits by the low bits of a shingle's digest."""
    bands = Bands(percent)
    size = np.bincount(doc, minlength=count)
    own = np.frexp(np.maximum(size, 1).astype(float))[1] - 1  # floor of log2
    out_doc, out_sig = [], []
    low = (digest & np.uint64(FREQUENT_BITS - 1)).astype(np.int64)
    common = ((frequent[low >> 3] >> (low & 7).astype(np.uint8)) & 1).astype(bool) if frequent is not None else np.zeros(len(digest), bool)
    weight = mix(digest + np.uint64(0x589965CC75374CC3))
    table = np.array([bands.groups(b) for b in range(int(own.max(initial=0)) + 1)])

    def in_groups(signs: np.ndarray, band: np.ndarray, most: np.ndarray, seed: int) -> np.ndarray:
        """Sign the sets for which ``signs`` holds; those that may have too few groups with two parts."""
        groups = np.where(signs, table[band], 0)
        base = np.cumsum(groups) - groups
        at = np.flatnonzero(signs[doc])
        d, spread = doc[at], mix(digest[at] ^ np.uint64(seed))
        slot = (base[d] + ((spread >> np.uint64(16)) % groups[d].astype(np.uint64)).astype(np.int64)) * 3 + ((spread & np.uint64(0xFFFF)) % np.uint64(3)).astype(np.int64)
        total = int(groups.sum())
        content = np.zeros(3 * total, np.uint64)
        np.add.at(content, slot, weight[at])
        content = content.reshape(-1, 3)
        held = np.bincount(slot, minlength=3 * total).reshape(-1, 3) > 0
        rare = np.bincount(slot[~common[at]], minlength=3 * total).reshape(-1, 3) > 0
        of = np.repeat(np.arange(count), groups)
        sure = np.bincount(of[held.sum(axis=1) >= 2], minlength=count) > most
        rarely = np.bincount(of[rare.sum(axis=1) >= 2], minlength=count) > most
        for out, y, z in ((0, 1, 2), (1, 0, 2), (2, 0, 1)):
            g = np.flatnonzero((held[:, y] | held[:, z]) & (rare[:, y] | rare[:, z] | ~rarely[of]))
            name = ((g - base[of[g]]) * 3 + out).astype(np.uint64) * np.uint64(64) + band[of[g]].astype(np.uint64)
            out_doc.append(of[g])
            out_sig.append(mix(mix(content[g, y] + mix(content[g, z] + np.uint64(1))) + mix(name + np.uint64(seed))))
        return signs & ~sure

    for down in (0, 1):
        band = own - down
        most = bands.differences(size, 2 ** (band + 1))
        few = (size > 0) if not down else (own > 0) & (percent * size <= 100 * (2**own - 1))
        for seed in (0x8EBC6AF09C88C6E3, 0x1D8E4E27C47D124F):
            few = in_groups(few, band, most // 2, seed)
        rarely = np.bincount(doc[~common], minlength=count) > most
        at = np.flatnonzero(few[doc] & (~common | ~rarely[doc]))  # every shingle a part
        out_doc.append(doc[at])
        out_sig.append(mix(mix(digest[at] + np.uint64(0x2545F4914F6CDD1D)) + band[doc[at]].astype(np.uint64)))
    return np.concatenate(out_doc), np.concatenate(out_sig)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def stars(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links from the least node of each signature to its others; each signature and its least node."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    head = np.ones(len(sig), bool)
    head[1:] = sig[1:] != sig[:-1]
    hub = node[np.flatnonzero(head)][np.cumsum(head) - 1] if len(sig) else node
    other = node != hub
    return hub[other], node[other], sig[head], node[head]


def frequent_shingles(given: DataFrame, width: int, rows: int) -> np.ndarray:
    """The bits, by the low bits of their digests, of the shingles that many of about ``SAMPLE_DOCS`` documents have."""
    part = int(2**30 * min(1.0, SAMPLE_DOCS / max(1, rows)))

    def run(batches):
        for batch in batches:
            for _, texts in chunks(batch.column(0), SLICE):
                yield pa.RecordBatch.from_arrays([signed(shingle_sets(texts, width)[1])], ["s"])

    sample = given.filter(F.pmod(F.xxhash64("sha"), F.lit(2**30)) < part).groupBy("sha").agg(F.first("t").alias("t"))
    bit = F.col("s").bitwiseAND(FREQUENT_BITS - 1) + 1  # as bitmap_bucket_number counts
    often = sample.select("t").mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= SAMPLE_COUNT).select(bit.alias("p"))
    buckets = often.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    out = np.zeros(FREQUENT_BITS // 8, np.uint8)
    for b, m in buckets.collect():  # 4 MB at most
        out[(b - 1) * 4096 :][: len(m)] = np.frombuffer(m, np.uint8)
    return out


def described(docs: DataFrame, key: str, text: str, width: int) -> tuple[DataFrame, DataFrame]:
    """``t, sha`` of the texts with shingles, and ``k, n, node, sha`` of all rows."""
    given = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.sha2(text, 256).alias("sha"))
    kind = given.schema["k"].dataType.simpleString()

    def describe(batches):
        for batch in batches:
            for at, texts in chunks(batch.column(1), SLICE):
                doc, digest = shingle_sets(texts, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(np.bincount(doc, minlength=len(texts))), signed(set_digests(doc, digest, len(texts))), batch.column(2).slice(at, len(texts))], ["k", "n", "node", "sha"])
            release()

    return given.filter("sha is not null").select("t", "sha"), saved(given.mapInArrow(describe, f"k {kind}, n long, node long, sha string"), "sets")


def clustered(given: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """``node, n, sha, cluster`` of the nodes that share a signature with another, directly or over others; large clusters are cut."""
    count, elements = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequent = frequent_shingles(given, width, count)
    met = components(saved(meetings(given, width, percent, frequent, max(LEAST_PARTS, elements // PART_ELEMENTS)), "met"))
    nodes = rows.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min("sha").alias("sha"))
    chosen = saved(nodes.join(met.withColumnRenamed("root", "cluster"), "node").select("node", "n", "sha", "cluster"), "chosen")
    large = saved(chosen.groupBy("cluster").agg(F.sum("n").alias("e"), F.count("*").alias("m")).filter(F.col("e") * F.col("m") > CUT_WORK).select("cluster"), "large")
    if large.isEmpty():
        return chosen
    inside = saved(chosen.join(large, "cluster", "left_semi"), "inside")
    apart = components(saved(prefix_meetings(given, inside, width, percent), "prefixes"))
    cut = inside.drop("cluster").join(apart.withColumnRenamed("root", "cluster"), "node").select(*chosen.columns)
    return saved(chosen.join(large, "cluster", "left_anti").unionByName(cut), "cut")


def texts_of(given: DataFrame, chosen: DataFrame) -> DataFrame:
    """``sha, t`` of the digests of a saved table, and some more; a Bloom filter keeps others out of the shuffle."""
    return split(given, F.col("sha"), filter_of(chosen, "sha", least=1))[0].groupBy("sha").agg(F.first("t").alias("t"))


def dealt(key: np.ndarray, node: np.ndarray, parts: int):
    """Batches ``part, node, many, key`` of keys by part: each node once, the number of its keys, and these."""
    part = ((key >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((key, node, part))
    key, node, part = key[order], node[order], part[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(node))).astype("<u4")
    ends, at = np.searchsorted(part, np.arange(parts + 1)), np.searchsorted(part[first], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(ends)).tolist():
        cols = ([p], [node[first[at[p] : at[p + 1]]].tobytes()], [many[at[p] : at[p + 1]].tobytes()], [key[ends[p] : ends[p + 1]].tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["part", "node", "many", "key"])


def gathered(batches) -> tuple[np.ndarray, np.ndarray]:
    """The keys and nodes of all batches of :func:`dealt`."""
    keys, nodes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for cols in slices(batches):
        for _, n, many, k in zip(*cols, strict=True):
            keys.append(np.frombuffer(k, np.uint64))
            nodes.append(np.repeat(np.frombuffer(n, np.int64), np.frombuffer(many, "<u4")))
    return np.concatenate(keys), np.concatenate(nodes)


def prefix_meetings(given: DataFrame, inside: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``a, b`` that connect the nodes of each cluster of ``inside`` which share a shingle of both their prefixes.

    Shingles are ordered by how many sets of the cluster have them, then by digest.  A task
    of the first shuffle counts a part of the shingles; the second one brings a node's together,
    without those that no other set has, of which the number is enough; the third one the prefixes by shingle.
    """
    parts = max(LEAST_PARTS, (inside.agg(F.sum("n")).first()[0] or 0) // PART_ELEMENTS)

    def flushed(sets):
        keys, nodes, held = [], [], 0
        for key, node in sets:
            keys.append(key)
            nodes.append(node)
            held += len(key)
            if held > FLUSH:
                yield from dealt(np.concatenate(keys), np.concatenate(nodes), parts)
                keys, nodes, held = [], [], 0
                release()
        if held:
            yield from dealt(np.concatenate(keys), np.concatenate(nodes), parts)

    def deal(batches):
        def sets():
            for batch in batches:
                for at, texts in chunks(batch.column(2), SLICE):
                    doc, digest = shingle_sets(texts, width)
                    cluster, node = (batch.column(c).slice(at, len(texts)).to_numpy() for c in (0, 1))
                    yield mix(digest ^ mix(cluster.astype(np.int64).view(np.uint64))[doc]), node[doc]

        yield from flushed(sets())

    def count(batches):
        key, node = gathered(batches)
        at, many = np.unique(key, return_inverse=True, return_counts=True)[1:]
        many = many[at].astype("<u4")
        order = np.argsort(node, kind="stable")
        key, node, many = key[order], node[order], many[order]
        cuts = np.flatnonzero(np.diff(node, prepend=node[:1] - 1, append=node[-1:] + 1)) if len(node) else np.zeros(1, np.int64)
        for x in range(0, len(cuts) - 1, 256):
            rows = []
            for y, z in zip(cuts[x : x + 256].tolist(), cuts[x + 1 : x + 257].tolist(), strict=False):
                shared = many[y:z] > 1
                rows.append((int(node[y]), int(z - y - shared.sum()), key[y:z][shared].tobytes(), many[y:z][shared].tobytes()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])], ["node", "alone", "key", "many"])

    def prefix(batches):
        def closed(node, alone, keys, many):
            key, many = np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(many), "<u4")
            size = alone + len(key)
            length = size - -(-percent * size // 100) + 1 - alone
            first = np.lexsort((key, many))[: max(0, length)]
            return key[first], np.full(len(first), node)

        def sets():
            held = None
            for cols in slices(batches):
                for node, alone, key, many in zip(*cols, strict=True):
                    if held is None or held[0] != node:
                        if held is not None:
                            yield closed(*held)
                        held = [node, 0, [], []]
                    held[1] += alone
                    held[2].append(key)
                    held[3].append(many)
            if held is not None:
                yield closed(*held)

        yield from flushed(sets())

    def meet(batches):
        a, b = forest(*stars(*gathered(batches))[:2])
        for x in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[x : x + 100_000]), pa.array(b[x : x + 100_000])], ["a", "b"])

    schema = "part int, node binary, many binary, key binary"
    sent = texts_of(given, inside).join(inside, "sha").select("cluster", "node", "t").mapInArrow(deal, schema)
    counted = sent.repartitionById(parts, "part").mapInArrow(count, "node long, alone long, key binary, many binary")
    first = counted.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(prefix, schema)
    return first.repartitionById(parts, "part").mapInArrow(meet, "a long, b long")


def meetings(given: DataFrame, width: int, percent: int, frequent: np.ndarray | None, parts: int) -> DataFrame:
    """Links ``a, b`` that connect all nodes which share a signature.

    A task finds the stars among its own signatures, contracts them to a forest, and
    sends one node of each signature on, so however many sets share a signature,
    at most one a flush meets the others.  What is sent is packed by part of the
    signatures' range: each node once, the number of its signatures, and five bytes
    of each.
    """
    shared = given.sparkSession.sparkContext.broadcast(frequent)
    names = ["part", "node", "many", "sig"]

    def packed(rows):
        for x in range(0, len(rows), 16):
            cols = list(zip(*rows[x : x + 16], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names)

    def sign(batches):
        sigs, nodes, held = [], [], 0

        def flush():
            sig = np.concatenate(sigs)
            sig = sig & np.uint64(2**40 - 1) | ((sig >> np.uint64(40)) % np.uint64(parts)) << np.uint64(40)  # what is sent on
            a, b, sig, node = stars(sig, np.concatenate(nodes))
            a, b = forest(a, b)
            part = (sig >> np.uint64(40)).astype(np.int64)
            order = np.lexsort((node, part))
            sig, node, part = sig[order], node[order], part[order]
            new = np.ones(len(node), bool)
            new[1:] = (node[1:] != node[:-1]) | (part[1:] != part[:-1])
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(node))).astype("<u4")
            five = np.ascontiguousarray(sig.view(np.uint8).reshape(-1, 8)[:, :5])
            ends, at = np.searchsorted(part, np.arange(parts + 1)), np.searchsorted(part[first], np.arange(parts + 1))
            out = [(p, node[first[at[p] : at[p + 1]]].tobytes(), many[at[p] : at[p + 1]].tobytes(), five[ends[p] : ends[p + 1]].tobytes()) for p in np.flatnonzero(np.diff(ends)).tolist()]
            if len(a):  # found links go anywhere
                out += [(int(a[0] % np.uint64(parts)), a[x : x + 50_000].tobytes(), None, b[x : x + 50_000].tobytes()) for x in range(0, len(a), 50_000)]
            return packed(out)

        for batch in batches:
            for _, texts in chunks(batch.column(0), SLICE):
                doc, digest = shingle_sets(texts, width)
                if len(doc):
                    of, sig = signatures(doc, digest, len(texts), percent, shared.value)
                    sigs.append(sig)
                    nodes.append(set_digests(doc, digest, len(texts))[of])
                    held += len(sig)
                if held > FLUSH:
                    yield from flush()
                    sigs, nodes, held = [], [], 0
                    release()
            release()
        if held:
            yield from flush()

    def meet(batches):
        sent = []
        for cols in slices(batches, 4):
            for p, n, many, s in zip(*cols, strict=True):
                if many is None:
                    yield pa.RecordBatch.from_arrays([signed(np.frombuffer(n, np.uint64)), signed(np.frombuffer(s, np.uint64))], ["a", "b"])
                else:
                    sent.append((p, n, many, s))
        for turn in range(TURNS):  # a share of the signatures at a time
            sig, node = [], []
            for p, n, many, s in sent:
                five = np.frombuffer(s, np.uint8).reshape(-1, 5)
                mine = np.flatnonzero(five[:, 0] % TURNS == turn)
                whole = np.zeros((len(mine), 8), np.uint8)
                whole[:, :5] = five[mine]
                sig.append(whole.reshape(-1).view(np.uint64) | np.uint64(p) << np.uint64(40))
                node.append(np.repeat(np.frombuffer(n, np.uint64), np.frombuffer(many, "<u4"))[mine])
            if sig:
                a, b = forest(*stars(np.concatenate(sig), np.concatenate(node))[:2])
                for x in range(0, len(a), 100_000):
                    yield pa.RecordBatch.from_arrays([signed(a[x : x + 100_000]), signed(b[x : x + 100_000])], ["a", "b"])

    sent = given.select("t").mapInArrow(sign, "part int, node binary, many binary, sig binary")
    return sent.repartitionById(parts, "part").mapInArrow(meet, "a long, b long")


def in_blocks(given: DataFrame, chosen: DataFrame, width: int, compare, schema: str) -> DataFrame:
    """What ``compare`` yields for the sets of clusters (of :func:`clustered`), which it gets in groups to compare.

    A cluster is cut into blocks by a hash of the nodes; each pair of blocks, and each
    block with itself, is a group.  ``compare`` takes lists ``cut, nodes, texts`` of groups:
    the nodes before ``cut`` are to be compared with those from it on, all with each other if it is 0.
    """
    size = F.sum("n")
    each = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(LEAST_BLOCK), size / BLOCKS))
    sizes = chosen.groupBy("cluster").agg(F.ceil(size / each).cast("int").alias("blocks"))
    placed = chosen.join(sizes, "cluster").select("sha", "node", "n", "cluster", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    texts = saved(texts_of(given, chosen).join(placed, "sha").select("cluster", "blocks", "block", "node", "n", "t"), "texts")
    parts = max(1, (texts.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0) // TASK_ELEMENTS)  # what all groups have
    pairs = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "t")

    def connect(batches):
        groups, held, at, size = [], [], None, 0

        def closed():
            alone = at[1] == at[2]
            held.sort(key=lambda r: (r[0], r[1]))
            return 0 if alone else sum(r[0] == at[1] for r in held), [r[1] for r in held], [r[2] for r in held]

        for cols in slices(batches):
            for row in zip(*cols, strict=True):
                if row[:3] != at:
                    if at is not None:
                        groups.append(closed())
                        if size > SLICE:
                            yield from compare(groups)
                            groups, size = [], 0
                            release()
                    held, at = [], row[:3]
                held.append(row[3:])
                size += len(row[5])
        if at is not None:
            groups.append(closed())
            yield from compare(groups)

    return pairs.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(connect, schema)


def matches(groups, width: int, percent: int):
    """Arrays ``a, b`` of the similar nodes of each group of :func:`in_blocks`, some at a time.

    The sets of all groups are made at once.  A set is compared with all others of its group by
    summing marks of its shingles over theirs.
    """
    doc, digest = sets_of([t for _, _, texts in groups for t in texts], width)
    name = np.array([n for _, nodes, _ in groups for n in nodes], np.int64)
    cuts = np.searchsorted(doc, np.arange(len(name) + 1))
    size, ids = np.diff(cuts), np.unique(digest, return_inverse=True)[1].astype(np.int32)
    marks, base = np.zeros(len(ids), np.int32), 0
    for cut, nodes, _ in groups:
        begin, end = base, base + len(nodes)
        base = end
        for y in range(begin + max(1, cut), end):
            most = begin + cut if cut else y
            near = 100 * np.minimum(size[begin:most], size[y]) >= percent * np.maximum(size[begin:most], size[y])
            if not near.any():
                continue
            mine = ids[cuts[y] : cuts[y + 1]]
            marks[mine] = 1
            both = np.add.reduceat(marks[ids[cuts[begin] : cuts[most]]], cuts[begin:most] - cuts[begin])
            marks[mine] = 0
            hit = begin + np.flatnonzero(near & (100 * both >= percent * (size[begin:most] + size[y] - both)))
            if len(hit):
                yield name[hit], np.full(len(hit), name[y])


def linked(given: DataFrame, clusters: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, b, n`` of all similar pairs of nodes: links ``a, b`` that span them, and with null ``b`` how many ``n`` the node ``a`` has in a group."""

    def compare(groups):
        ends, us, vs, held = [], [], [], 0
        for a, b in matches(groups, width, percent):
            ends += [a, b]
            us.append(a)
            vs.append(b)
            held += len(a)
            if held > HELD_LINKS:
                u, v = forest(np.concatenate(us), np.concatenate(vs))
                us, vs, held = [u], [v], len(u)
                yield from counted(ends)
                ends = []
        if us:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], ["a", "b", "n"])
            yield from counted(ends)

    def counted(ends):
        if ends:
            node, n = np.unique(np.concatenate(ends), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(n)], ["a", "b", "n"])

    return saved(in_blocks(given, clusters, width, compare, "a long, b long, n long"), "links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``key, n_shingles, component_id, n_links, node, text_sha256, kept, repeats`` of every row; see the module's text.

    ``component_id`` is the least key reachable over links, ``n_links`` how many other
    sets are similar to the row's, ``node`` the digest of the row's set.  ``kept`` marks the row that stays for its
    component: the one with the least known key, of these the least node and then the
    least ``text_sha256``; rows without shingles all stay.  Components are told apart by
    their nodes, so keys may repeat or be null.  ``repeats`` says that the component has
    several rows, so that rows equal in key and text may all be marked.
    """
    given, rows = described(docs, key, text, width)
    links = linked(given, clustered(given, rows, width, percent), width, percent)
    reached = components(links.filter("b is not null"))
    counts = links.filter("b is null").groupBy("a").agg(F.sum("n").alias("n_links")).withColumnRenamed("a", "node")

    rank = F.struct(F.col("k").isNull().alias("unknown"), "k", "node", "sha")
    each = rows.filter("n > 0").groupBy("node").agg(F.min("k").alias("least"), F.min(rank).alias("first"), F.count("*").alias("many"))
    nodes = saved(each.join(reached, "node", "left").join(counts, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least", "first", "many", F.coalesce("n_links", F.lit(0)).alias("n_links")), "nodes")
    group = nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("stays"), (F.sum("many") > 1).alias("repeats"))
    by_node = saved(nodes.select("node", "root", "n_links").join(group, "root").drop("root"), "components")
    some = rows.filter("n > 0").join(by_node, "node")
    kept = F.col("k").eqNullSafe(F.col("stays.k")) & (F.col("node") == F.col("stays.node")) & (F.col("sha") == F.col("stays.sha"))
    some = some.select("k", F.col("n").alias("n_shingles"), "component_id", "n_links", "node", F.col("sha").alias("text_sha256"), kept.alias("kept"), "repeats")
    none = rows.filter("n = 0").select("k", F.col("n").alias("n_shingles"), F.col("k").alias("component_id"), F.lit(0).cast("long").alias("n_links"), "node", F.col("sha").alias("text_sha256"), F.lit(True).alias("kept"), F.lit(False).alias("repeats"))
    return some.unionByName(none).withColumnRenamed("k", key)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each component.

    Rows are decided by key and text, as keys may repeat or be null; of rows equal in
    both one stays.  Rows whose text no decision may concern, by a Bloom filter, pass
    without a shuffle.
    """
    found = near_duplicates(docs, key, text, width, percent)
    said = saved(found.filter("repeats").select(F.col(key).alias("k"), F.col("text_sha256").alias("sha"), "kept").distinct(), "said")
    given = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].alias("key"), F.sha2(docs[text], 256).alias("digest"))
    given = given.withColumn("digest", F.coalesce("digest", F.lit("0" * 64)))  # null texts are in no component
    maybe, others = split(given, F.col("digest"), filter_of(said, "sha", least=1))
    decided = maybe.join(said, (F.col("digest") == F.col("sha")) & F.col("key").eqNullSafe(F.col("k")), "left")
    alone = decided.filter("kept is null").select("row.*")
    one = decided.filter("kept").groupBy("key", "digest").agg(F.first("row").alias("row")).select("row.*")
    return others.select("row.*").unionByName(alone).unionByName(one)


def similar_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``node_a, node_b, key_a, key_b``: every link between two different sets, once, with the least key of each.

    Rows with equal sets are one class, for which its least key stands; a pair of
    classes is a row, so a cluster of n near copies has up to n (n - 1) / 2.
    """
    given, rows = described(docs, key, text, width)

    def compare(groups):
        for a, b in matches(groups, width, percent):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    pairs = saved(in_blocks(given, clustered(given, rows, width, percent), width, compare, "a long, b long"), "pairs")
    least = saved(rows.filter("n > 0").groupBy("node").agg(F.min("k").alias("k")), "least")
    for side in "ab":
        pairs = pairs.join(least.select(F.col("node").alias(side), F.col("k").alias(f"key_{side}")), side)
    return pairs.select(F.col("a").alias("node_a"), F.col("b").alias("node_b"), "key_a", "key_b")
