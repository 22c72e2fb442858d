"""A run from samples to metrics against plain Python."""

import random

import numpy as np
import pytest

from kgloom.operators import fit, run

SAMPLE = "p string, rule_ids array<int>, gold int"
APPLIED = "direction string, p string, q int, cand int, rule_ids array<int>"
GOLDS = "direction string, p string, q int, gold int"
RULES = [("r", 1, 0.4), ("r", 2, 0.5), ("r", 3, 0.3), ("s", 1, 0.2), ("s", 4, 0.6)]


def plain_metrics(applied, golds, weights, biases, entities):
    """Mean reciprocal rank and hits of each relation and direction."""
    by = {}
    for d, p, q, c, ids in applied:
        w = sum(weights.get((p, r), 0.0) for r in ids)
        by.setdefault((d, p, q), {})[c] = round(float(1 / (1 + np.exp(-(w + biases[p])))) if p in biases else 0.0, 9)
    out = {}
    for d, p, q, g in golds:
        found = by.get((d, p, q))
        own = {x for dd, pp, qq, x in golds if (dd, pp, qq) == (d, p, q)}
        rr = hit = 0
        if found:
            others = [s for c, s in found.items() if c not in own and s > 0]
            s = found.get(g, 0.0)
            rank = sum(o > s for o in others) + (sum(o == s for o in others) + 2) / 2 if s > 0 else len(others) + (entities - len(others) + 1) / 2
            rr, hit = 1 / rank, rank == 1
        a = out.setdefault((p, d), [0, 0.0, 0.0])
        out[p, d] = [a[0] + 1, a[1] + rr, a[2] + hit]
    return {k: (n, rr / n, h / n) for k, (n, rr, h) in out.items()}


def test_a_run_keeps_the_best_epoch_and_weighs_relations(spark):
    rng = random.Random(8)
    samples = [(p, rng.sample(ids, rng.randrange(1, 3)), rng.randrange(2)) for p, ids in (("r", [1, 2, 3]), ("s", [1, 4, 9])) for _ in range(30)]
    applied = list({(d, p, q, c): (d, p, q, c, rng.sample([1, 2, 3, 4], rng.randrange(1, 4))) for d in ("head", "tail") for p in "rst" for q in range(6) for c in rng.sample(range(12), 5)}.values())
    golds = lambda seed: sorted({(d, p, random.Random(seed + n).randrange(7), random.Random(seed * 3 + n).randrange(12)) for n, (d, p) in enumerate([(d, p) for d in ("head", "tail") for p in "rst"] * 5)})
    valid, test = golds(100), golds(500)
    frames = lambda g: run.Split(spark.createDataFrame(applied, APPLIED), spark.createDataFrame(g, GOLDS))
    table, rules = spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(RULES, "p string, rule_id int, conf double")
    got = run.completion(table, rules, frames(valid), frames(test), 12, every=2, epochs=6, rates=(0.3,))
    best = {}
    for epoch in (2, 4, 6):
        f = fit.train(table, rules, epochs=epoch, rates=(0.3,))
        weights, biases = {(r.p, r.rule_id): r.trained for r in f.rules.collect()}, {r.p: r.bias for r in f.relations.collect()}
        on_valid = plain_metrics(applied, valid, weights, biases, 12)
        for p in "rs":
            mean = np.mean([m[1] for (q, _), m in on_valid.items() if q == p])
            if p not in best or mean > best[p][0] + 1e-12:
                best[p] = (mean, weights, biases)
    want = {k: v for p in "rs" for k, v in plain_metrics(applied, test, best[p][1], best[p][2], 12).items() if k[0] == p}
    found = {(r.p, r.direction): (r.n, r.mrr, r.h1) for r in got.by_direction.collect()}
    for k, v in want.items():
        assert found[k] == pytest.approx(v)
    assert {r.p: r.error for r in got.failed.collect()} == {"t": "no rules"}
    mean = {p: sum(v[1] for (q, _), v in want.items() if q == p) / 2 for p in "rs"}
    n = {p: sum(v[0] for (q, _), v in want.items() if q == p) for p in "rs"}
    overall = got.overall.first()
    assert (overall.relations, overall.n) == (2, n["r"] + n["s"]) and overall.mrr == pytest.approx(sum(mean[p] * n[p] for p in "rs") / sum(n.values()))
    assert {r.p: r.mrr for r in got.by_relation.collect()} == pytest.approx(mean)


def test_scores_with_pairs(spark):
    applied = spark.createDataFrame([("tail", "r", 1, 5, [1, 2]), ("tail", "r", 1, 6, [2]), ("tail", "t", 1, 5, [1])], APPLIED)
    weights = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.25)], "p string, rule_id int, trained double")
    pairs = spark.createDataFrame([("r", 1, 2, 0.3)], "p string, a int, b int, trained double")
    biases = spark.createDataFrame([("r", 0.1, 2.0)], "p string, bias double, gamma double")
    got = {(r.p, r.cand): r.score for r in run.scored(applied, weights, biases, "surprisal", True, pairs).collect()}
    assert got == pytest.approx({("r", 5): 1 - np.exp(-(0.75 + 0.6 + 0.01)), ("r", 6): 1 - np.exp(-0.26), ("t", 5): 0.0})
    got = {(r.p, r.cand): r.score for r in run.scored(applied, weights, biases, "surprisal", False, pairs).collect()}
    assert got["r", 6] == pytest.approx(1 - np.exp(-np.log1p(np.exp(0.35))))
