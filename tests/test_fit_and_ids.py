"""Fits against plain numpy, checkpoints, id mapping against its definition, numbered lines, samples and small writers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.operators import fit, graph, rules, score
from kgloom.sources import formats

SAMPLES = [("r", [1, 2], 1), ("r", [1], 0), ("r", [2, 3], 1), ("r", [2, 9], 0), ("r", [1, 2], 1), ("q", [7], 0), ("q", [7, 8], 1), ("q", [], 0)]
RULES = [("r", 1, 0.4), ("r", 2, 0.5), ("r", 3, 0.3), ("q", 7, 0.6), ("q", 8, 0.2), ("z", 5, 0.1)]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(SAMPLES, "p string, rule_ids array<int>, gold int"), spark.createDataFrame(RULES, "p string, rule_id int, conf double")


def plain_adam(p, model, constrained, reduction, steps, rate, pairs=()):
    """The fit of one relation by its definition, with a numeric gradient."""
    ids = [r for q, r, _ in RULES if q == p]
    conf = np.array([c for q, _, c in RULES if q == p])
    rows = [(rs, g) for q, rs, g in SAMPLES if q == p]
    start = conf if model == "linear" else -np.log1p(-conf)
    lift = np.array([w for *_, w in pairs])
    x = np.concatenate([np.sqrt(start) if constrained else start, np.sqrt(lift) if constrained else lift, [0.1, 1.0]])
    n, k = len(ids), len(pairs)
    pos, neg = sum(g for _, g in rows), sum(1 - g for _, g in rows)

    def loss(x):
        w = x[: n + k] ** 2 if constrained else x[: n + k]
        out = 0.0
        for rs, g in rows:
            z = sum(w[ids.index(r)] for r in rs if r in ids)
            z += x[-1] * sum(w[n + j] for j, (a, b, _) in enumerate(pairs) if a in rs and b in rs)
            if model == "linear":
                pred = 1 / (1 + np.exp(-(z + x[-2])))
            else:
                z = z + x[-2] ** 2 if constrained else np.log1p(np.exp(z + x[-2]))
                pred = 1 - np.exp(-z)
            pred = min(max(pred, 1e-7), 1 - 1e-7)
            entry = -(g * 5 * np.log(pred) + (1 - g) * np.log(1 - pred))
            out += entry / {"mean": len(rows), "sum": 1, "class_mean": 2 * (pos if g else neg)}[reduction]
        return out

    m, v, first = np.zeros(len(x)), np.zeros(len(x)), loss(x)
    for step in range(1, steps + 1):
        last = loss(x)
        g = np.array([(loss(x + h) - loss(x - h)) / 2e-6 for h in np.eye(len(x)) * 1e-6])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return (x[:n] ** 2 if constrained else x[:n]), x[-2], x[-1], first, last


@pytest.mark.parametrize("model, constrained, reduction", [("linear", True, "mean"), ("linear", False, "class_mean"), ("surprisal", True, "sum"), ("surprisal", False, "mean")])
def test_fit_equals_its_definition(spark, data, model, constrained, reduction):
    pairs = [(1, 2, 0.3)] if model == "surprisal" else []
    table = spark.createDataFrame([("r", *x) for x in pairs], "p string, a int, b int, lift double") if pairs else None
    got = fit.train(*data, model=model, epochs=4, rates=(0.05,), constrained=constrained, pairs=table, reduction=reduction, bias=0.1)
    weights = {(r.p, r.rule_id): r.trained for r in got.rules.collect()}
    relations = {r.p: r for r in got.relations.collect()}
    for p in "rq":
        w, bias, gamma, first, last = plain_adam(p, model, constrained, reduction, 4, 0.05, pairs if p == "r" else [])
        assert [weights[p, r] for q, r, _ in RULES if q == p] == pytest.approx(w, abs=1e-4)
        r = relations[p]
        assert (r.bias, r.gamma if pairs and p == "r" else 1.0, r.first_loss, r.last_loss) == pytest.approx((bias, gamma if pairs and p == "r" else 1.0, first, last), abs=1e-4)
    assert {r.p: r.error for r in fit.failed(got, spark.createDataFrame([("r",), ("z",), ("y",)], "p string")).collect()} == {"z": "no samples", "y": "no rules"}


def test_fit_keeps_the_best_epoch_and_stops(spark, data):
    asked = []

    def evaluate(weights, biases):
        asked.append({(r.p, r.rule_id): r.trained for r in weights.collect()})
        n = len(asked)
        by = {"r": {1: 0.2, 2: 0.5}.get(n, 0.5), "q": 0.9 if n == 1 else 0.3, "z": 0.0}
        return spark.createDataFrame([(p, d, m) for p, m in by.items() for d in ("head", "tail")], "p string, direction string, mrr double")

    got = fit.train(*data, epochs=40, rates=(0.05,), evaluate=evaluate, every=2, patience=3)
    weights = {(r.p, r.rule_id): r.trained for r in got.rules.collect()}
    assert len(asked) == 5 and weights["r", 1] == asked[1]["r", 1] and weights["q", 7] == asked[0]["q", 7]
    history = score.stopping_epoch(got.history.filter("p = 'r'"), 3, "mrr").collect()
    assert [r.epoch for r in history] == [10] and {r.epoch for r in score.best_checkpoint(got.history.filter("p = 'r'"), ["p", "direction"]).collect()} == {4}


def test_fit_options(spark, data):
    with pytest.raises(ValueError):
        fit.train(*data, model="other")
    with pytest.raises(ValueError):
        fit.train(*data, reduction="other")
    assert fit.grid({"a": [1, 2], "b": [3, 4]}) == [{"a": 1, "b": 3}, {"a": 1, "b": 4}, {"a": 2, "b": 3}, {"a": 2, "b": 4}]
    runs = fit.tuned(*data, {"model": ["linear", "surprisal"], "constrained": [True]}, epochs=2, rates=(0.01,))
    assert runs.groupBy("run").count().count() == 2
    assert formats.schedule("0.01, 0.005") == (0.01, 0.005) and formats.schedule("3,1", int) == (3, 1)
    for bad in ("", "a,b", "1.5"):
        with pytest.raises(ValueError):
            formats.schedule(bad, int)


def rows_of(fitted):
    close = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    return close(fitted.rules), close(fitted.pairs.select("p", "a", "b", "original", "trained")), close(fitted.relations)


@pytest.mark.parametrize("options", [{}, {"batch": 2}, {"batch": 2, "reduction": "class_mean", "bias": None, "constrained": False}])
@pytest.mark.parametrize("model", ["linear", "surprisal"])
def test_distributed_fit_equals_whole_fit(spark, data, model, options):
    samples = data[0].withColumn("ord", F.monotonically_increasing_id())
    pairs = spark.createDataFrame([("r", 1, 2, 0.3)], "p string, a int, b int, lift double")
    one, two = (rows_of(fit.train(samples, data[1], model, pairs, epochs=3, rates=(0.05, 0.01), whole_values=n, **options)) for n in (10**6, 0))
    assert one == two


def test_batches_take_a_step_each(spark):
    """Two batches of one relation, by hand."""
    rows = [("r", 2, [1], 0), ("r", 0, [1], 1), ("r", 1, [2], 1), ("r", 3, [1, 2], 0)]
    rules_ = [("r", 1, 0.25), ("r", 2, 0.36)]
    got = fit.train(spark.createDataFrame(rows, "p string, ord long, rule_ids array<int>, gold int"), spark.createDataFrame(rules_, "p string, rule_id int, conf double"), epochs=1, rates=(0.1,), batch=2)
    x, m, v = np.array([0.5, 0.6, 0.0]), np.zeros(3), np.zeros(3)
    for step, batch in enumerate(([([0], 1), ([1], 1)], [([0], 0), ([0, 1], 0)]), 1):
        g = np.zeros(3)
        for held, gold in batch:
            pred = 1 / (1 + np.exp(-(sum(x[h] ** 2 for h in held) + x[2])))
            dz = (pred if not gold else -5 * (1 - pred)) / 2
            for h in held:
                g[h] += dz * 2 * x[h]
            g[2] += dz
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    assert [r.trained for r in got.rules.orderBy("rule_id").collect()] == pytest.approx((x[:2] ** 2).tolist())
    assert got.relations.first().bias == pytest.approx(x[2])


@pytest.mark.parametrize("whole_values", [10**6, 0])
def test_grid_equals_single_fits_in_one_scan(spark, data, whole_values):
    options = {"positive_weight": [5.0, 30.0], "constrained": [True, False], "epochs": [2, 4]}
    got = fit.tuned(*data, options, whole_values=whole_values, rates=(0.05,))
    assert got.select("run").distinct().count() == 8
    found = {(json.dumps(o, sort_keys=True), r.p): r for o in fit.grid(options) for r in fit.train(*data, rates=(0.05,), **o).relations.collect()}
    for r in got.collect():
        one = found[r.options, r.p]
        assert (r.bias, r.first_loss, r.last_loss) == pytest.approx((one.bias, one.first_loss, one.last_loss)) and (r.epochs, r.status) == (one.epochs, one.status)
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n, grid in enumerate(({"positive_weight": [5.0]}, options | {"epochs": [4]})):
        spark.sparkContext.setJobGroup(f"grid{n}", "")
        fit.tuned(*data, grid, whole_values=whole_values, rates=(0.05,), **({"epochs": 4} if n == 0 else {})).collect()
        jobs.append(len(tracker.getJobIdsForGroup(f"grid{n}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1]


def test_fit_keeps_types(spark):
    samples = spark.createDataFrame([(3, [10**12, 2], 1), (3, [2], 0)], "p int, rule_ids array<long>, gold int")
    rules_ = spark.createDataFrame([(3, 10**12, 0.4), (3, 2, 0.2)], "p int, rule_id long, conf double")
    for whole in (10**6, 0):
        got = fit.train(samples, rules_, epochs=2, rates=(0.01,), whole_values=whole)
        assert dict(got.rules.dtypes)["p"] == dict(got.relations.dtypes)["p"] == "int" and dict(got.rules.dtypes)["rule_id"] == "bigint"
        assert sorted((r.p, r.rule_id) for r in got.rules.collect()) == [(3, 2), (3, 10**12)]


def test_seeded_bias_lies_within_its_bound():
    drawn = [fit.Setting(bias=None, seed=s).first_bias("r", 16) for s in range(200)]
    assert max(drawn) <= 0.25 and min(drawn) >= -0.25 and len(set(drawn)) > 190 and abs(np.mean(drawn)) < 0.05


def plain_mapping(index, lines):
    """An entry after the other takes its full signature, its text, its position or the first free line."""
    out, used = {}, set()
    for local, full, text in index:
        order = [i for i, f, _ in lines if f == full] + [i for i, _, t in lines if t == text]
        order += [lines[local][0]] if local < len(lines) else []
        order += [i for i, *_ in lines]
        got = next((i for i in order if i not in used), None)
        if got is None:
            raise ValueError
        used.add(got)
        out[local] = got
    return out


def test_local_to_global_equals_its_definition(spark):
    rng = np.random.default_rng(1)
    index, lines, want = [], [], {}
    for rel in range(30):
        n, more = int(rng.integers(1, 9)), int(rng.integers(0, 3))
        one = [(k, int(rng.integers(1, 3)), 1, f"t{rng.integers(0, 4)}") for k in range(n)]
        two = [(100 * rel + 3 * k, int(rng.integers(1, 3)), 1, f"t{rng.integers(0, 4)}") for k in range(n + more)]
        if rel % 3 == 0:
            two = [(100 * rel + 3 * k, *x[1:]) for k, x in enumerate(one)]
        index += [(f"r{rel}", *x) for x in one]
        lines += [(i, f"r{rel}", a, b, t) for i, a, b, t in two]
        found = plain_mapping([(k, (a, b, t), t) for k, a, b, t in one], [(i, (a, b, t), t) for i, a, b, t in two])
        want |= {(f"r{rel}", k): i for k, i in found.items()}
    got = rules.local_to_global(spark.createDataFrame(index, "rel string, local_idx int, num_preds int, num_true int, rule string"), spark.createDataFrame(lines, "rule_id int, head_rel string, num_preds int, num_true int, rule string"))
    assert {(r.rel, r.local_idx): r.rule_id for r in got.collect()} == want
    short = rules.local_to_global(spark.createDataFrame([("a", 0, 1, 1, "x"), ("a", 1, 1, 1, "x")], "rel string, local_idx int, num_preds int, num_true int, rule string"), spark.createDataFrame([(4, "a", 1, 1, "x")], "rule_id int, head_rel string, num_preds int, num_true int, rule string"))
    with pytest.raises(Exception, match="no line is left"):
        short.collect()
    with pytest.raises(Exception, match="not in order"):
        rules.strictly_indexed(spark.createDataFrame([("a", 1)], "rel string, local_idx int")).collect()


def test_lines_are_numbered_over_splits(spark, tmp_path):
    texts = {f"f{k}": [f"{k}-{n}" if n % 7 else "" for n in range(1, 3000 * (k + 1))] for k in range(3)}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        for blank in (True, False):
            found = formats.numbered_lines(spark, str(tmp_path), blank)
            got = sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in found.collect())
            assert got == sorted((name, n, x) for name, lines in texts.items() for n, x in enumerate([x for x in lines if blank or x], 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sample_has_its_size_and_no_repetition(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("s"), F.lit("p").alias("p"), (F.col("id") % 3).cast("string").alias("o"))
    one, two = (sorted(map(tuple, graph.sample_of(rows, 137, seed).collect())) for seed in (1, 1))
    assert one == two and len(set(one)) == 137 and sorted(map(tuple, graph.sample_of(rows, 137, 2).collect())) != one
    assert graph.sample_of(rows.limit(0), 5).count() == 0 and graph.sample_of(rows, 5000).count() == 1000


def test_small_writers(spark, tmp_path):
    d = str(tmp_path)
    formats.write_ids(spark.createDataFrame([(1, "b c"), (0, 'a"x')], "id int, token string"), f"{d}/ids")
    assert sorted(map(tuple, formats.ids(spark, f"{d}/ids").collect())) == [(0, 'a"x'), (1, "b c")]
    (tmp_path / "map").write_text("1\ta\n\n2 b c\n 3   d \n")
    assert sorted(map(tuple, formats.mapping(spark, f"{d}/map").collect())) == [("1", "a"), ("3", "d")]
    (tmp_path / "idmap").write_text("1\ta\tb\n\n2\tc\n")
    assert sorted(map(tuple, formats.ids(spark, f"{d}/idmap").collect())) == [(1, "a\tb"), (2, "c")]
    formats.write_by_relation(spark.createDataFrame([("x", 1), ("y", 2)], "p string, n int"), f"{d}/by")
    assert sorted(x.name for x in (tmp_path / "by").iterdir() if x.is_dir()) == ["p=x", "p=y"]
    formats.write_config(spark, {"lr": (0.1,), "model": "linear"}, f"{d}/config")
    assert json.loads(spark.read.text(f"{d}/config").first().value) == {"lr": [0.1], "model": "linear"}
    kept = spark.createDataFrame([(1, 10, 4, 0.25, "h(X,Y) <= b(X,Y)"), (2, 9, 1, 0.1, "h(X,Y) <= c(Y,X)")], "rule_id int, num_preds int, num_true int, conf double, rule string")
    formats.write_removed(kept, f"{d}/removed")
    assert spark.read.text(f"{d}/removed").count() == 2
    formats.write_rules(kept.coalesce(1), f"{d}/rules")
    back = rules.from_lines(formats.rule_lines(spark, f"{d}/rules")).orderBy("rule_id").collect()
    assert [(r.rule_id, r.num_preds, r.num_true, r.rule) for r in back] == [(1, 10, 4, "h(X,Y) <= b(X,Y)"), (2, 9, 1, "h(X,Y) <= c(Y,X)")]
    (tmp_path / "index").write_text(">>> a\n1\t5\t2\t0.4\th(X) <= b\n\nshort\n0\t6\t3\t0.5\tg\n>>> b\n0\t1\t1\t1\tk\n")
    found = formats.rule_index(spark.read.text(f"{d}/index", wholetext=True)).collect()
    assert sorted((r.rel, r.local_idx, r.num_preds, r.rule) for r in found) == [("a", 0, 6, "g"), ("a", 1, 5, "h(X) <= b"), ("b", 0, 1, "k")]
    with pytest.raises(ValueError):
        formats.permuted(spark.range(1), "abc")
