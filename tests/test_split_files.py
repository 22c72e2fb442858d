"""Large files that are split among tasks, against reading each as one value; blocks of vectors and of samples."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.operators import samples, score
from kgloom.sources import formats


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.usefixtures("small_splits")
def test_rule_index_over_splits(spark, tmp_path):
    rng = random.Random(2)
    texts = {}
    for name in ("one", "two"):
        lines = ["lost\tbefore\tany\theader\tline"]
        for k in range(60):
            lines += ["", f">>>rel {k} "] + [f"{i}\t{rng.randrange(99)}\t{i}\t0.5\th(X,Y) <= b{i}(X,Y)" for i in range(rng.choice((0, 1, 40)))] + ["short\tline"]
        texts[name] = "\n".join(lines + [">>>", "0\t1\t1\t0\tlost"])
        (tmp_path / name).write_text(texts[name])
    found = formats.rule_index_files(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    got = sorted((r.file.rsplit("/", 1)[1], r.rel, r.local_idx, r.num_preds, r.num_true, r.rule) for r in found.collect())
    want = [(name, *r) for name, t in texts.items() for r in formats.rule_index(spark.createDataFrame([(t[t.index(">>>") :],)], "value string")).collect()]
    assert got == sorted(w for w in want if w[1])


@pytest.mark.usefixtures("small_splits")
def test_one_applied_object_over_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "QUERIES_A_BLOCK", 7)
    rng = random.Random(4)
    odd = ["a", "b}", "{c", 'q"uote', "back\\slash", "é}{\\\"}", "x\ny", "}}}", ""]
    name = lambda k: f"{rng.choice(odd)}{k}"
    objects = {}
    for file in ("one.json", "two.json", "three.json"):
        objects[file] = {d: {name(p): {name(q): {name(c): [rng.randrange(9) for _ in range(rng.randrange(3))] for c in range(rng.randrange(4))} for q in range(rng.randrange(6))} for p in range(rng.randrange(9))} for d in ("head", "tail")}
        (tmp_path / file).write_text(json.dumps(objects[file], ensure_ascii=file == "one.json", indent=None if file != "two.json" else 1) + ("\n" if file == "one.json" else ""))
    (tmp_path / "none.json").write_text("{}")
    got = sorted((r.file.rsplit("/", 1)[1], r.direction, r.p, r.q, r.cand, r.rule_ids) for r in formats.applied_files(spark, str(tmp_path)).collect())
    assert got == sorted((f, d, p, q, c, ids) for f, o in objects.items() for d, a in o.items() for p, b in a.items() for q, m in b.items() for c, ids in m.items())


def test_blocks_of_vectors_keep_the_first(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in rng.integers(-2, 3, 3 if i % 7 else 4)]) for i in range(90)] + [(900, None), (901, [])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = {(r.q, r.pos): (r.cand, r.score) for r in score.dot_topk(table, table, 5, block=16).collect()}
    want = {}
    for q, a in vectors:
        found = sorted(((-round(float(np.dot(a, b)), 6), c) for c, b in vectors if a and b and len(a) == len(b)))[:5]
        want |= {(q, n): (c, -s) for n, (s, c) in enumerate(found, 1)}
    assert {k: v for k, v in got.items() if k[0] != 901} == want


@pytest.mark.parametrize("block", [4, 32_768])
def test_pair_hits_from_a_bitmap_index(spark, monkeypatch, block):
    monkeypatch.setattr(samples, "INDEX_BLOCK", block)
    rng = random.Random(block)
    rows = [(rng.choice("rs"), [1] + [rng.randrange(2, 9) for _ in range(rng.randrange(4))], rng.randrange(2)) for _ in range(80)] + [("r", [], 1)]
    pairs = [(p, a, b) for p in "rst" for a in range(1, 9) for b in range(a, 10)]
    got = {tuple(r) for r in samples.pair_hit_counts(spark.createDataFrame(rows, "p string, rule_ids array<int>, gold int"), spark.createDataFrame([*pairs, pairs[0]], "p string, a int, b int")).collect()}
    count = {(p, a, b): sum(g == 1 and q == p and a in ids and b in ids for q, ids, g in rows) for p, a, b in pairs}
    assert got == {(*k, n) for k, n in count.items() if n}
