"""Hand-made cases of ranks, rules, readers and comparisons."""

from pyspark.sql import functions as F

from kgloom.operators import apply, compare, rules, score
from kgloom.operators.fit import phase_lengths
from kgloom.sources import formats


def test_rank_fixture(spark):
    scored = [(k, c, s) for k in ("k1", "k2", "k4") for c, s in ((1, 0.9), (2, 0.9), (3, 0.5))] + [("k5", 1, 0.9), ("k5", 2, 0.5), ("k6", 1, 0.9), ("k6", 2, 0.5), ("k6", 3, 0.4)]
    golds = [("k1", 2), ("k2", 7), ("k3", 4), ("k4", 1), ("k4", 2), ("k5", 2), ("k6", 5)]
    ranked = score.ranks(spark.createDataFrame(scored, "q string, cand int, score double"), spark.createDataFrame(golds, "q string, gold int"), 10, ["q"], spark.createDataFrame([("k5", 1), ("k6", 1)], "q string, cand int"))
    got = {(r.q, r.gold): r["rank"] for r in ranked.collect()}
    assert got == {("k1", 2): 1.5, ("k2", 7): 7.0, ("k3", 4): None, ("k4", 1): 1.0, ("k4", 2): 1.0, ("k5", 2): 1.0, ("k6", 5): 6.5}
    m = score.metrics(ranked, []).first()
    assert (m.n, round(m.mrr, 6), round(m.h1, 6), round(m.h10, 6)) == (7, 0.566196, round(3 / 7, 6), round(6 / 7, 6))


def test_rule_lines_keep_line_numbers(spark, tmp_path):
    (tmp_path / "rules").write_text("120\t60\t0.48\th(X,Y) <= a(X,A), b(A,Y)\n\nx y z\n10.9 5 0.1 g(X,c) <= b(X,d)\nbad\t3\t0\tq(X,Y) <= r(X,Y)")
    found = {r.rule_id: r for r in rules.from_lines(formats.rule_lines(spark, str(tmp_path / "rules"))).collect()}
    assert sorted(found) == [1, 4, 5]
    assert (found[1].num_preds, found[1].head_rel, found[1].conf) == (120, "h", 60 / 125)
    assert (found[4].num_preds, found[5].num_preds, found[5].conf) == (10, 0, 0.0)


def test_triples_lenient_and_blank_lines(spark, tmp_path):
    (tmp_path / "t").write_text("a\tr\tb\n\na r  c\nx\ty\nq\tr\ts\tt\n")
    assert sorted(map(tuple, formats.triples(spark, str(tmp_path / "t")).collect())) == [("a", "r", "b"), ("a", "r", "c")]


def test_multiset_difference_keeps_repetitions(spark):
    df = spark.createDataFrame([([1, 1, 2], [1])], "a array<int>, b array<int>")
    assert df.select(compare.multiset_difference("a", "b").alias("x")).first().x == [1, 2]


def test_maxplus_longer_list_wins_on_prefix(spark):
    rows = [("q", "a", 1, 0.9), ("q", "b", 1, 0.9), ("q", "b", 2, 0.1), ("q", "c", 3, 0.95)]
    top = apply.maxplus_topk(spark.createDataFrame(rows, "q string, cand string, rule_id int, conf double"), ["q"], 3).orderBy("pos").collect()
    assert [r.cand for r in top] == ["c", "b", "a"]


def test_json_round_trip(spark):
    rows = [("head", "r", "q1", "c", [1, 2]), ("tail", "r", "q2", "c", [])]
    df = spark.createDataFrame(rows, "direction string, p string, q string, cand string, rule_ids array<int>")
    assert sorted(r.direction for r in formats.nested(df).collect()) == ["head", "tail"]


def test_positive_ids_keep_the_row(spark):
    df = spark.createDataFrame([([0, -1],), ([3, 0],)], "rule_ids array<int>")
    assert [r.rule_ids for r in apply.positive_ids(df).collect()] == [[], [3]]


def test_phases():
    assert phase_lengths(60, 3) == [24, 24, 12] and phase_lengths(7, 2) == [4, 3]


def test_adding_a_rule_that_never_fires_changes_no_rank(spark):
    scored = spark.createDataFrame([("q", 1, 0.5), ("q", 2, 0.0)], "q string, cand int, score double")
    gold = spark.createDataFrame([("q", 2)], "q string, gold int")
    more = scored.unionByName(spark.createDataFrame([("other", 9, 0.7)], "q string, cand int, score double"))
    assert [score.ranks(x, gold, 5, ["q"]).first()["rank"] for x in (scored, more)] == [3.5, 3.5]


def test_entity_labels_of_lists(spark):
    assert spark.range(1).select(F.round(compare.mean_of_top(F.array(F.lit(0.5), F.lit(0.5))), 3).alias("m")).first().m == 0.1


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_rules_prune_the_scans_of_other_relations(spark):
    from kgloom.operators import graph

    d = "/root/testdata/sf0.001"
    rows = spark.createDataFrame([(1, "cust_nation", False, "in_region", False)], "rule_id int, rel1 string, inv1 boolean, rel2 string, inv2 boolean")
    found = plan(apply.cyclic(rows, graph.project(spark, d), 2))
    assert found.count("FileScan") == 2 and "BroadcastHashJoin" in found


def test_topk_is_cut_before_the_shuffle(spark):
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(20)], "vec_id long, embedding array<double>")
    found = plan(score.dot_topk(v.filter("vec_id < 2"), v, 3))
    assert "WindowGroupLimit" in found and "Partial" in found


def test_ranks_of_many_golds_and_levels(spark):
    import random

    rng = random.Random(3)
    scored = [(q, c, rng.choice([0.0, 0.25, 0.5, 0.75])) for q in range(6) for c in rng.sample(range(30), rng.randint(0, 25))]
    golds = [(q, g) for q in range(7) for g in rng.sample(range(35), rng.randint(1, 6))]
    gone = [(q, c) for q in range(7) for c in rng.sample(range(30), 4)]
    frames = (spark.createDataFrame(scored, "q int, cand int, score double"), spark.createDataFrame(golds, "q int, gold int"), 40, ["q"], spark.createDataFrame(gone, "q int, cand int"))
    got = {(r.q, r.gold): (r.n_cands, r["rank"]) for r in score.ranks(*frames).collect()}
    for q, g in golds:
        own = dict((c, s) for k, c, s in scored if k == q)
        others = [s for c, s in own.items() if s > 0 and (q, c) not in golds and (q, c) not in gone]
        s = own.get(g, 0.0)
        want = sum(o > s for o in others) + (sum(o == s for o in others) + 2) / 2 if s > 0 else len(others) + (40 - len(others) + 1) / 2
        assert got[q, g] == (len(others), want if own else None)


def test_strict_readers_reject(spark, tmp_path):
    import pytest

    (tmp_path / "t").write_text("a\tr\tb\nx\ty\n")
    with pytest.raises(Exception, match="not three fields"):
        formats.triples(spark, str(tmp_path / "t"), strict=True).collect()
    (tmp_path / "html").write_text("a &amp; b\tr\t&#233;\n")
    assert tuple(formats.unescaped(formats.triples(spark, str(tmp_path / "html"))).first()) == ("a & b", "r", "\u00e9")


def test_nested_json_is_read_back(spark):
    rows = [(d, p, f"q{q}", c, list(range(q))) for d in ("head", "tail") for p in ("r", 'quo"te') for q in range(3) for c in ("x", "\u00e9 y")]
    df = spark.createDataFrame(rows, "direction string, p string, q string, cand string, rule_ids array<int>")
    back = formats.flattened(formats.nested(df).select(F.col("json").alias("value")))
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, rows))


def test_cyclic_rules_deal_keys_with_many_pairs(spark, monkeypatch):
    """Pairs over a node with many neighbours come from several tasks, each pair once, as do those of entities with two ways on."""
    from kgloom.operators import apply, skew

    monkeypatch.setattr(apply, "MOST_PAIRS", 50)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        side = spark.range(60).select(F.lit("hub").alias("k"), F.col("id").alias("a"))
        met = skew.hub_join(side, side.withColumnRenamed("a", "b"), ["k"], most_pairs=50)
        tasks = met.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in tasks) == 3600 and len(tasks) > 2 and met.distinct().count() == 3600
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    rows = [(f"x{n}", "b", "n1") for n in range(40)] + [(f"x{n}", "b", "n2") for n in range(5)] + [("x0", "b", "n1")]
    for some in (rows, rows[:40]):
        triples = spark.createDataFrame(some, "s string, p string, o string")
        rules = spark.createDataFrame([(1, "b", False, "b", True)], "rule_id int, rel1 string, inv1 boolean, rel2 string, inv2 boolean")
        want = {(a, c) for a, _, n in some for c, _, m in some if n == m}
        got = [(r.x, r.y) for r in apply.cyclic(rules, triples, 2).collect()]
        assert len(got) == len(set(got)) and set(got) == want
