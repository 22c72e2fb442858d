"""What keeps figures from growing faster than the input: shuffles, partitions and joins of the plans, with the results beside."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.operators import answers, compare, fit, graph, run, samples, score, skew
from kgloom.plans import catalogue
from kgloom.sources import formats
from kgloom.store import saved


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return plan(df).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


@pytest.fixture
def triples(spark):
    rows = [(f"s{k % 7}", f"r{k % 3}", f"o{k % 5}") for k in range(60)]
    return spark.createDataFrame([*rows, rows[0]], "s string, p string, o string"), set(rows)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_partitions_grow_with_rows(spark, monkeypatch):
    rows = spark.range(100)
    assert skew.tasks_of(rows) is None
    monkeypatch.setattr(skew, "ROWS_A_TASK", 4)
    assert skew.tasks_of(rows) == 25
    assert skew.dealt(rows, 25, "id").rdd.getNumPartitions() == 25


def test_batches_do_not_meet_by_relation(spark, no_broadcast):
    """the first numbers of the relations are broadcast, so no task gets all samples of one."""
    lists = spark.createDataFrame([("a", n) for n in range(5)] + [("b", n) for n in range(5, 8)], "p string, n long")
    found = fit._in_batches(lists, 2)
    assert "SortMergeJoin" not in plan(found)
    assert sorted((r.p, r.n, r.batch) for r in found.collect()) == [("a", n, n // 2) for n in range(5)] + [("b", n, (n - 5) // 2) for n in range(5, 8)]


def test_nan_is_the_largest_dot_product(spark):
    """the first of a block are found without a full sort; NaN is above all, as in SQL, and ties go by candidate."""
    rows = [(0, [1.0, 0.0]), (1, [float("nan"), 1.0]), (2, [3.0, 1.0]), (3, [3.0, 2.0]), (4, [2.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = score.dot_topk(v.filter("vec_id = 0"), v, 2, block=10).orderBy("pos").collect()
    assert [(r.cand, r.pos) for r in got] == [(1, 1), (2, 2)] and np.isnan(got[0].score) and got[1].score == 3.0


def test_encoding_shuffles_triples_twice(spark, triples, no_broadcast):
    """the distinct triples are joined by subject where they are, then dealt by object."""
    rows, want = triples
    ids = graph.tokens(rows).select(F.col("token"), F.xxhash64("token").alias("id"))
    names = rows.select(F.col("p").alias("token")).distinct().select("token", F.xxhash64("token").alias("id"))
    got = graph.encode(graph.by_subject(rows, 20), ids, F.broadcast(names), strict=True, tasks=20)
    hashed = {tuple(r) for r in spark.createDataFrame([*want], "s string, p string, o string").select(*[F.xxhash64(c) for c in "spo"]).collect()}
    assert sorted(map(tuple, got.collect())) == sorted(hashed)
    assert plan(graph.encode(graph.by_subject(rows, 20), ids, F.broadcast(names), tasks=20)).count("hashpartitioning(s#") == 2  # triples, ids


def test_index_and_sizes(spark, triples):
    """Both completion queries and the sizes of relations from triples dealt by subject."""
    rows, want = triples
    once = graph.by_subject(rows, None)
    found = graph.index(once, F.count("*").alias("n"), F.min("a").alias("first"))
    pairs = [("tail", p, s, o) for s, p, o in want] + [("head", p, o, s) for s, p, o in want]
    keys = {x[:3] for x in pairs}
    assert sorted(map(tuple, found.collect())) == sorted((*k, len([x for x in pairs if x[:3] == k]), min(x[3] for x in pairs if x[:3] == k)) for k in keys)
    assert shuffles(found) == 3  # the triples for either side, and partial figures of the heads
    sizes = {tuple(r) for r in graph.sizes(once).collect()}
    assert sizes == {(p, len([x for x in want if x[1] == p]), len({x[0] for x in want if x[1] == p}), len({x[2] for x in want if x[1] == p})) for p in ("r0", "r1", "r2")}


def test_sets_take_two_bytes_an_answer(spark):
    """Arrays of positions are short, and meet in as many partitions as asked for."""
    edges = spark.createDataFrame([(1, 5), (1, 6), (2, 6)], "a long, b long")
    last = spark.createDataFrame([(5, 32_767), (5, 32_768), (6, 32_767), (6, 99_999)], "a long, b long")
    found = answers.along(edges, answers.sets(last, "a", "b", 9), "a", "b", tasks=9)
    assert dict(found.light.dtypes)["positions"] == "array<smallint>"
    assert "9, REPARTITION_BY_NUM" in plan(found.light) or "9), REPARTITION_BY_NUM" in plan(found.light)
    assert sorted(map(tuple, answers.pairs(found).collect())) == [(1, 32_767), (1, 32_768), (1, 99_999), (2, 32_767), (2, 99_999)]


SIDE = "direction string, p string, q long, cand long, rule_ids array<int>"


def test_comparison_meets_in_given_partitions(spark):
    """keys of both sides meet once, in as many partitions as their rows need."""
    a = spark.createDataFrame([("tail", "r", 1, 1, [1]), ("tail", "r", 1, 1, [1]), ("tail", "r", 1, 2, [2]), ("tail", "r", 2, 1, [3])], SIDE)
    b = spark.createDataFrame([("tail", "r", 1, 1, [1]), ("tail", "r", 3, 1, [3])], SIDE)
    found = compare.summary(a, b, 17)
    assert tuple(found.first()) == (3, 2, 1)
    assert "17), REPARTITION_BY_NUM" in plan(found)
    assert tuple(compare.report_counts(a, b, 17).first()) == (3, 2, 2, 2, 1, False)
    assert tuple(compare.summary(a.limit(0), b.limit(0)).first()) == (0, 0, 0)


def test_levels_copy_no_row(spark):
    """every level is counted from the one below it."""
    rows = [("tail", "r", 1, 1, [1]), ("tail", "r", 1, 1, [1]), ("tail", "r", 1, 2, [2]), ("tail", None, 2, 1, [3]), ("head", "r", 1, 1, [1]), (None, "r", 1, 1, [1])]
    found = compare.counts_by_level(spark.createDataFrame(rows, SIDE))
    assert {r.level: (r.entries, r.keys) for r in found.collect()} == {"direction": (5, 2), "relation": (5, 3), "query": (5, 3), "candidate": (5, 4)}
    assert "Expand" not in plan(found)
    assert compare.counts_by_level(spark.createDataFrame([], SIDE)).count() == 0


def test_splits_are_made_once(spark, triples, tmp_path):
    """the split that is written as lines is the one that is counted, though its rows are drawn anew each time; only different values are copied for all."""
    rows, _ = triples
    drawn = rows.distinct().filter(F.expr("rand() < 0.5"))
    counts = formats.write_splits({"train": drawn, "test": rows.limit(1)}, str(tmp_path / "x"))
    found = {r.split: r.triples for r in counts.collect()}
    assert found["train"] == spark.read.text(str(tmp_path / "x" / "train")).count()
    assert found["all"] == found["train"] + 1


def test_samples_meet_their_answers_once(spark, no_broadcast):
    """Samples and answers that are dealt by query are labelled without another shuffle."""
    applied = spark.createDataFrame([("tail", "r", 1, 1, [1]), ("tail", "r", 1, 2, [2]), ("tail", "r", 1, 3, []), ("tail", "r", 2, 1, [1]), ("head", "r", 1, 1, [4]), ("tail", None, 1, 1, [5]), ("tail", "r", 1, None, [6])], SIDE)
    gold = spark.createDataFrame([("tail", "r", 1, 2), ("tail", "r", 1, 2), ("tail", "r", 1, 9), ("tail", "r", 1, None), ("tail", None, 1, 1), ("tail", "r", 7, 1)], "direction string, p string, q long, a long")
    found = samples.labelled(applied.repartition("q"), gold.repartition("q"))
    assert sorted(map(str, found.collect())) == sorted(map(str, spark.createDataFrame([("r", "tail", 1, 1, [1], 0), ("r", "tail", 1, 2, [2], 1), ("r", "tail", 1, None, [6], 0)], "p string, direction string, q long, cand long, rule_ids array<int>, gold int").collect()))
    assert found.schema["cand"].dataType == applied.schema["cand"].dataType
    assert shuffles(found) == 2  # those above


@pytest.mark.parametrize("held", [True, False])
def test_evaluations_shuffle_once(spark, held):
    """F16: metrics from the rows that all evaluations of a split share are those of single ranks."""
    rng = random.Random(5)
    applied = list({(d, p, q, c): (d, p, q, c, rng.sample(range(1, 6), rng.randrange(4))) for d in ("head", "tail") for p in "rst" for q in range(8) for c in rng.sample(range(12), rng.randrange(8))}.values())
    golds = [(d, p, rng.randrange(10), rng.choice([*range(14), None])) for d in ("head", "tail") for p in "rstu" for _ in range(9)] * 2
    out = [(d, p, q, rng.randrange(12)) for d, p, q, _ in golds] * 2
    split = run.Split(spark.createDataFrame(applied, SIDE), spark.createDataFrame([*golds, ("tail", None, 1, 1)], "direction string, p string, q long, gold long"), spark.createDataFrame(out, "direction string, p string, q long, cand long") if held else None)
    weights = spark.createDataFrame([(p, r, w) for p in "rs" for r, w in ((1, 0.5), (2, 0.5), (3, 0.25), (9, 1.0))], "p string, rule_id int, trained double")
    biases = spark.createDataFrame([("r", 0.1, 1.0), ("s", -30.0, 1.0)], "p string, bias double, gamma double")
    want = score.metrics(score.ranks(run.scored(split.applied, weights, biases), split.golds, 20, run.KEYS, split.filtered), ["p", "direction"])
    rows = saved(run.asked(split), "asked")
    found = run.metrics_of(rows, weights, F.broadcast(biases), 20)
    key = lambda df: {(r.p, r.direction): (r.n, r.mrr, r.h1, r.h10) for r in df.collect()}
    assert {k: pytest.approx(v) for k, v in key(want).items()} == key(found)
    one = run.metrics_of(rows, F.broadcast(weights), F.broadcast(biases), 20)
    assert shuffles(one) == 2  # the rows, and partial figures of relations


def test_lists_of_rules_and_the_rule_table(spark):
    """No list passes through an aggregate that sorts twice, and rules are told from lines without a row for each line."""
    path = "/root/testdata/sf0.001"
    assert "ObjectHashAggregate" not in plan(catalogue.applied(spark, path))
    assert "l_orderkey" not in plan(catalogue._rule_table(spark, path))
    want = {}
    for r in catalogue.fired(spark, path).collect():
        want.setdefault((r.q, r.cand), set()).add(r.rule_id)
    assert {(r.q, r.cand): r.rule_ids for r in catalogue.applied(spark, path).collect()} == {k: sorted(v) for k, v in want.items()}


def test_first_seen_needs_no_sort_of_all_rows(spark):
    """first places are kept by hash, and a table is read once for all its relations."""
    rows = spark.createDataFrame([("b", "r", "a", 5), ("c", "r", "b", 7), ("a", "r", "d", 9), ("c", "r", None, 1)], "s string, p string, o string, at long")
    found = graph.first_seen(rows)
    assert sorted(map(tuple, found.collect()), key=lambda x: x[1]) == [("c", 2), (None, 3), ("b", 10), ("a", 11), ("d", 19)]
    assert "SortAggregate" not in plan(found)
    assert [r.token for r in graph.first_seen_dictionary(rows).orderBy("id").collect()] == ["c", None, "b", "a", "d"]
    path = "/root/testdata/sf0.001"
    placed = graph.in_file_order(spark, path)
    assert plan(placed).split("== Initial Plan ==")[-1].count("lineitem.parquet") == 1
    relations = [p for p, *_ in graph.PROJECTION]
    ends = placed.groupBy("p").agg(F.min("at").alias("least"), F.max("at").alias("most")).collect()
    in_order = [x for r in sorted(ends, key=lambda r: relations.index(r.p)) for x in (r.least, r.most)]
    assert in_order == sorted(in_order)
    lines = [(r.s, r.at) for r in placed.filter("p = 'contains'").collect()]
    assert [int(s[2:]) for s, _ in sorted(lines, key=lambda x: x[1])] == sorted(int(s[2:]) for s, _ in lines)
