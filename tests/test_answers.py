"""Bounded sets of answers against sets of pairs."""

import random

import pytest

from kgloom.operators import answers


@pytest.mark.parametrize("hub", [2, 10**6])
def test_sets_along_paths_equal_pairs(spark, hub):
    rng = random.Random(hub)
    ids = [0, 1, 7, 8, 32_767, 32_768, 40_000, 99_999]
    first = [(rng.randrange(12), rng.randrange(15)) for _ in range(40)] + [(0, k) for k in range(15)]
    second = [(rng.randrange(15), rng.randrange(20)) for _ in range(50)]
    last = [(rng.randrange(20), rng.choice(ids)) for _ in range(60)]
    table = lambda rows: spark.createDataFrame([*rows, rows[0]], "a long, b long")
    one = answers.along(table(second), answers.sets(table(last), "a", "b"), "a", "b", hub)
    two = answers.along(table(first), one, "a", "b", hub)
    hop = lambda r, s: {(a, c) for a, b in r for x, c in s if x == b}
    want_one, want_two = hop(second, last), hop(first, hop(second, last))
    assert sorted(map(tuple, answers.pairs(one).collect())) == sorted(want_one)
    assert sorted(map(tuple, answers.pairs(two).collect())) == sorted(want_two)
    known = {(a, b) for a in range(12) for b in ids if (a + b) % 3 == 0} | {(77, 5)}
    got = answers.support(two, answers.sets(spark.createDataFrame([*known], "a long, b long"), "a", "b")).first()
    assert (got.num_preds, got.num_true) == (len(want_two), len(want_two & known))


def test_sets_of_nothing(spark):
    none = spark.createDataFrame([(None, 1), (1, None)], "a long, b long")
    found = answers.along(none.limit(0), answers.sets(none, "a", "b"), "a", "b")
    assert answers.pairs(found).count() == 0
    assert tuple(answers.support(found, answers.sets(none, "a", "b")).first()) == (0, 0)


@pytest.mark.parametrize("hub, whole", [(2, 10**6), (10**6, 4), (10**6, 10**6)])
def test_lists_and_buckets_equal_pairs(spark, hub, whole):
    """nodes of many edges, or with an edge to a node of many answers, are left to buckets, all others are one row each."""
    rng = random.Random(whole + hub)
    ids = [0, 1, 32_767, 32_768, 40_000, 99_999, 2**40 if whole > 4 and hub > 2 else 77_777]
    first = [(rng.randrange(12), rng.randrange(15)) for _ in range(30)] + [(3, k) for k in range(15)] + [(None, 1), (2, None)]
    last = [(k % 15, rng.choice(ids)) for k in range(45)] + [(4, a) for a in ids] + [(None, 5), (1, None)]
    table = lambda rows, names: spark.createDataFrame([*rows, rows[0]], ", ".join(f"{n} long" for n in names))
    edges, pairs = table(list(dict.fromkeys(first)), "qv").distinct(), table(last, "va")
    found = answers.followed(edges, answers.lists_of(pairs, "v", "a", 5, whole), "q", "v", pairs, "a", hub)
    want = {(q, a) for q, v in first for w, a in last if v == w and v is not None and q is not None and a is not None}
    assert sorted(map(tuple, answers.followed_pairs(found).collect())) == sorted(want)
    assert (found.rest is None) == (hub > 2 and whole > 4)
    known = {(q, a) for q in range(12) for a in ids if (q + a) % 3 == 0} | {(77, 5)}
    got = answers.followed_support(found, spark.createDataFrame([*known], "q long, a long"), "q", "a").first()
    assert (got.num_preds, got.num_true) == (len(want), len(want & known))


def test_answers_that_lie_apart_are_one_row(spark):
    """ids of many buckets do not scatter a node's answers over as many rows."""
    pairs = spark.createDataFrame([(1, k * 40_000) for k in range(20)] + [(2, 7)], "v long, a long")
    assert answers.sets(pairs, "v", "a").light.count() == 21
    held = answers.lists_of(pairs, "v", "a", 3)
    assert sorted((r.node, len(r.low), r.big) for r in held.collect()) == [(1, 20, False), (2, 1, False)]
    assert dict(held.dtypes)["low"] == "array<smallint>"
    none = answers.followed(pairs.limit(0).toDF("q", "v"), held, "q", "v", pairs, "a")
    assert tuple(answers.followed_support(none, pairs.limit(0), "v", "a").first()) == (0, 0)
