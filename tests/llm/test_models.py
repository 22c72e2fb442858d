"""Katz scores, source divergence and importance resampling against brute force, with nulls, ties, long texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.llm import divergence, katz, queries, resampling, words

SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ("k", "t", "row", "part", "kind", "block", "n", "w", "u", "score", "rank", "run", "pos", "term", "value", "item", "range", "weight")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "the of and Sun moon éa ÖB xi".split() for b in ("", "s", "ing", "7")]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=n))
    out = [(k, text(rng.randrange(5, 60)), rng.choice(["en", "de", "fr"]), rng.choice("aaab c".split(" ") + ["b"])) for k in range(240)]
    out += [(500 + k, out[7][1], "en", "a") for k in range(30)]  # copies
    out += [(600, None, None, None), (601, "", "en", "b"), (602, " \t\n", "xx", "lonely"), (603, "123 !! ??", "en", None), (None, text(40), "en", "a"), (None, text(40), "en", "a"), (7, text(25), "de", "b"), (604, "One. TWO,two;three\x00four\x7f", "de", "a"), (605, text(9_000), "fr", "b"), (606, "a" * 30_000, "fr", "b"), (607, None, "en", "quiet")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    out = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in CLASH:
        out = out.withColumn(c, F.lit("clash"))
    return out


def test_words():
    text = "Ab c\tD " + "x" * 50 + " é É tail"
    for piece in (1, 3, 7, 1000):
        assert [w for found in words.words(text, words.BLANKS, piece) for w in found] == re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    assert list(words.words(None, words.BLANKS)) == [] and [w for x in words.words("a1b-2{c}\x7fd", words.ALPHANUMERIC) for w in x] == [b"a1b", b"2", b"c", b"d"]
    assert [w for x in words.words("a1b-é", words.LETTERS) for w in x] == [b"a", b"b", "é".encode()]
    number = words.Numbers()
    assert number.of([b"a", b"b", b"a"])[0] == number.of([b"a"])[0] and words.Places().of([b"a", b"b", b"a"]).tolist() == [0, 1, 0]


# Katz


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), "end"]


class Plain:
    """The model by its definition."""

    def __init__(self, texts):
        self.one, self.two = Counter(), defaultdict(Counter)
        for t in texts:
            x = tokens(t)
            self.one.update(x)
            for a, b in zip(["begin", *x], x, strict=False):
                self.two[a][b] += 1
        self.n, self.v = sum(self.one.values()), len(self.one)
        counts = lambda values: [Counter(values)[r] for r in range(1, katz.K + 2)]
        self.d1, self.d2 = katz.discounts(counts(self.one.values())), katz.discounts(counts([c for f in self.two.values() for c in f.values()]))
        self.left = sum((1 - self.d1[c]) * c for c in self.one.values() if c <= katz.K)
        self.whole = self.n if self.left > 0 else self.n + 1

    def alone(self, w):
        c = self.one.get(w, 0)
        return (self.d1[c] if c <= katz.K else 1) * c / self.whole if c else (self.left if self.left > 0 else 1) / self.whole

    def p(self, u, w):
        if u not in self.two:
            return self.alone(w)
        f = self.two[u]
        left = sum((1 - self.d2[c]) * c for c in f.values() if c <= katz.K)
        whole = sum(f.values()) + (left <= 0)
        if c := f.get(w, 0):
            return (self.d2[c] if c <= katz.K else 1) * c / whole
        return (left if left > 0 else 1) / whole / (1 - sum(map(self.alone, f))) * self.alone(w)

    def score(self, text):
        x = tokens(text)
        base = sum(math.log10((self.one.get(w, 0) + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in x)
        return len(x), sum(w in self.one for w in x), base, sum(math.log10(self.p(u, w)) for u, w in zip(["begin", *x], x, strict=False))


@pytest.mark.parametrize("head_words, part, block", [(2**18, 4_000_000, 1_000_000), (5, 200, 300), (0, 50, 40)])
def test_katz_equals_its_definition(spark, docs, rows, head_words, part, block):
    trained = [r for r in rows if r[0] is None or r[0] % 4]
    model = katz.train(docs.filter("doc_id is null or doc_id % 4 <> 0"), head_words=head_words, part=part, block=block)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6), r.train_tokens) for r in katz.score(docs, model, block=block).collect())
    plain = Plain([r[1] for r in trained])
    want = sorted((r[0] is None, r[0] or 0, *(round(x, 6) for x in plain.score(r[1])), plain.n) for r in rows)
    assert [g[:4] for g in got] == [w[:4] for w in want] and np.allclose([g[4:] for g in got], [w[4:] for w in want], atol=1e-5)
    for u in ["begin", b"the", b"ofs", "nobody"]:
        assert sum(plain.p(u, w) for w in [*plain.one, "unknown"]) == pytest.approx(1)


def test_katz_of_nothing(spark, docs):
    empty = katz.train(docs.limit(0))
    assert {(r.base_score, r.score, r.n_known, r.train_tokens) for r in katz.score(docs, empty).collect()} == {(0.0, 0.0, 0, 0)}
    assert katz.score(docs.limit(0), katz.train(docs)).count() == 0


def test_discounts_lie_within_bounds():
    assert katz.discounts([1000, 400, 220, 140, 100, 75])[1] == pytest.approx((2 * 400 / 1000 - 6 * 75 / 1000) / (1 - 6 * 75 / 1000))
    for n in ([0] * 6, [5, 0, 0, 0, 0, 0], [0, 3, 9, 0, 0, 1], [1, 1, 1, 1, 1, 50]):
        assert all(0 < d < 1 for d in katz.discounts(n)[1:])


def test_packed_numbers():
    for x in ([], [0], [2**64 - 1, 5, 5, 2**63]):
        x = np.array(x, np.uint64)
        assert katz.unpack(katz.pack(x)).tolist() == katz.unpack_sorted(katz.pack_sorted(x)).tolist() == x.tolist()


# Divergence


def plain_audit(rows, least, top):
    docs = [(lang or "", source or "", re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().lower())) for _, t, lang, source in rows]
    df, count, groups = Counter(), defaultdict(Counter), sorted({(a, b) for a, b, _ in docs})
    for a, b, found in docs:
        df.update((a, w) for w in set(found))
        count[a, b].update(found)
    out = set()
    for lang in {a for a, _ in groups}:
        kept = [w for (a, w), n in df.items() if a == lang and n >= least]
        all_ = Counter()
        for g in groups:
            if g[0] == lang:
                all_.update(count[g])

        def shares(c):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (n + 2 * len(kept)) for w in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        mine, whole = {b: shares(count[a, b]) for a, b in groups if a == lang}, shares(all_)
        for b, p in mine.items():
            parts = {"pair": [(-sum(f(p[w], q[w]) for w in kept), o) for o, q in mine.items() if o != b], "term": [(-f(p[w], whole[w]), w.decode()) for w in kept if count[lang, b][w] and p[w] > whole[w]]}
            for part, found in parts.items():
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out |= {(lang, b, part, item, -v, n) for n, (v, item) in enumerate(found, 1) if part == "pair" or n <= top}
    return out


@pytest.mark.parametrize("cells", [None, 2**16])
def test_audit_equals_exact_counts(docs, rows, cells):
    for least, top in ((10, 10), (3, 2), (10**6, 10)):
        got = [tuple(r) for r in divergence.audit(docs, least, top, cells=cells).select("lang", "source", "part", "item", "value", "rank").collect()]
        assert len(got) == len(set(got)) and set(got) == plain_audit(rows, least, top)


def test_sketch_never_underestimates(docs, rows):
    given = divergence._plain(docs, "text", "lang", "source")
    df = Counter()
    for _, t, lang, _ in rows:
        df.update((lang or "", w) for w in set(re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().lower())))
    sketch = divergence.Sketch(given, 10, 2**16)
    for (lang, w), n in df.items():
        assert n < 10 or sketch.possible(words.Numbers().of([w]), lang)[0]
    rare = [(lang, w) for (lang, w), n in df.items() if n < 5]
    assert rare and sum(bool(sketch.possible(words.Numbers().of([w]), lang)[0]) for lang, w in rare) < len(rare) / 2
    assert divergence.audit(docs.limit(0)).count() == 0


# Resampling


def plain_draw(rows, target, share=25, seed=7, least=20):
    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def found(t):
        w = pattern.findall((t or "").encode().lower())
        return len(w), [zlib.crc32(x) % 10_000 for x in [*w, *(a + b" " + b for a, b in zip(w, w[1:], strict=False))]]

    f, t = [found(r[1]) for r in rows], Counter(b for x in target for b in found(x)[1])
    s = Counter(b for _, x in f for b in x)
    many, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (many + 10_000) / ((s[b] + 1) * (wanted + 10_000))))
    out = []
    for (key, *_), (n, x) in zip(rows, f, strict=True):
        w = sum(map(gain, x)) // len(x) if x else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(x), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, order[: share * len(order) // 100]


@pytest.mark.parametrize("range_rows, samples", [(200_000, 65_536), (7, 20), (1, 1000)])
def test_draw_equals_a_sort(spark, docs, rows, monkeypatch, range_rows, samples):
    monkeypatch.setattr(resampling, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(resampling, "SAMPLES", samples)
    target = ["the sun 7 the moons", None, "", "éas of the ÖB"]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    for share in (25, 100, 0):
        want, order = plain_draw(rows, target, share)
        got = [tuple(r) for r in resampling.resample(docs, aim, share).collect()]
        assert sorted(map(repr, (g[:4] for g in got))) == sorted(map(repr, (w[:4] for w in want)))
        ranked = sorted((g for g in got if g[4] is not None), key=lambda g: g[4])
        assert [g[4] for g in ranked] == list(range(1, len(order) + 1)) and [g[:4] for g in ranked] == [w[:4] for w in order]
    assert resampling.resample(docs.limit(0), aim).count() == 0
    assert {r.weight for r in resampling.resample(docs.filter("doc_id = 600"), aim.limit(0)).collect()} == {0}


def test_tournament_merges_runs():
    rng = random.Random(1)
    for many in (0, 1, 2, 5, 9):
        runs = [sorted((rng.randrange(20), k, n) for n in range(rng.randrange(12))) for k in range(many)]
        tree, out = resampling.Tournament(runs), []
        while got := tree.take(3):
            out += runs[got[0]][got[1] : got[2]]
        assert out == sorted(x for r in runs for x in r)


def test_registered_queries_of_this_module():
    assert {"op11_katz_backoff", "op12_source_divergence", "op13_importance_resampling"} <= set(queries.QUERIES)
