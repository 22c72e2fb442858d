"""Readers and writers of rankings, metrics, weights and counts; degrees of pairs."""

import pytest

from kgloom.operators import samples
from kgloom.sources import formats


def test_rankings(spark, tmp_path):
    (tmp_path / "ranking-valid").write_text("a r b\nHeads: x\t0.9\ty\t0.5\nTails:\n\nc r d\nHeads: z\t1.0\nTails: u\t0.25\tv\t0.125\tw\t0.1\n")
    (tmp_path / "other").write_text("e r f\nHeads: x\t0.9\nTails: x\t0.9\n")
    found = formats.rankings(spark, str(tmp_path), 2, "*ranking*")
    rows = [(r.s, r.direction, r.pos, r.cand, r.conf) for r in found.orderBy("s", "direction", "pos").collect()]
    assert rows == [("a", "head", 0, "x", 0.9), ("a", "head", 1, "y", 0.5), ("c", "head", 0, "z", 1.0), ("c", "tail", 0, "u", 0.25), ("c", "tail", 1, "v", 0.125)]


def test_metric_files_and_weights(spark, tmp_path):
    (tmp_path / "metric-1.json").write_text('{\n"p": 1, "mrr": 0.5\n}')
    (tmp_path / "metric-2.json").write_text('{"p": 2, "mrr": 0.25}')
    (tmp_path / "rest.json").write_text('{"p": 3}')
    assert sorted((r.p, r.mrr) for r in formats.metric_files(spark, str(tmp_path)).collect()) == [(1, 0.5), (2, 0.25)]
    fitted = spark.createDataFrame([("r", 1, 0.123456789, 0.5), ("q", 2, 0.5, 0.25)], "p string, rule_id int, original double, trained double")
    hits = spark.createDataFrame([("r", 1, 7)], "p string, rule_id int, train_hit_count long")
    formats.write_weights(fitted, hits, str(tmp_path / "w"))
    back = spark.read.csv(str(tmp_path / "w"), header=True, inferSchema=True)
    assert sorted((r.p, r.ruleID, r.original, r.train_hit_count) for r in back.collect()) == [("q", 2, 0.5, 0), ("r", 1, 0.1234568, 7)]


def test_counts_and_degrees(spark):
    a = spark.createDataFrame([("x", "r", "y"), ("y", "q", "x")], "s string, p string, o string")
    b = spark.createDataFrame([("x", "r", "z")], "s string, p string, o string")
    assert sorted(map(tuple, formats.dataset_counts({"train": a, "test": b}).collect())) == [("all", 3, 3, 2), ("test", 1, 2, 1), ("train", 2, 2, 2)]
    pairs = spark.createDataFrame([("r", 1, 2, 4.0), ("r", 1, 1, 4.0)], "p string, a int, b int, lift double")
    found = {(r.a, r.b): r.lift for r in samples.degree_normalised(pairs, 0.5).collect()}
    assert found == {(1, 2): pytest.approx(4 / 2**0.5), (1, 1): pytest.approx(2.0)}


def test_a_folder_is_needed_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from kgloom import store

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(applicationId="app-x", master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_dir(session)
    session.sparkContext.master = "local[2]"
    assert store.shared_dir(session) == store.shared_dir(session)
    session.conf.get = lambda key, default: "file:///shared"
    assert store.tables_dir(session) == "file:///shared/tables/app-x"


def test_tables_are_dropped_by_application(spark, monkeypatch, tmp_path):
    import os

    from kgloom import store

    monkeypatch.setattr(store, "shared_dir", lambda spark: str(tmp_path))
    assert store.saved(spark.range(5), "five").count() == 5 and len(os.listdir(store.tables_dir(spark))) == 1
    (tmp_path / "tables" / "other").mkdir()
    store.drop_tables(spark)
    assert os.listdir(tmp_path / "tables") == ["other"]
