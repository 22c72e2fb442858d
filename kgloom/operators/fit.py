"""Fitting weights of rules and rule pairs by relation, with Adam, for one setting or many at once.

Relations are fitted apart from each other.  A relation whose samples hold at most
``WHOLE_VALUES`` rule ids is fitted whole in one task, as many relations at a time as there are
tasks; its epochs are no jobs.  A larger one stays a distributed table: in each step every
task adds up the gradient of its own samples, for all settings in one scan, the sums meet by
blocks of ``BLOCK`` features, and the driver takes the step, holding one number a feature and
optimiser state of these relations, at most ``MAX_FEATURES``.

With full batches the loss of a sample hangs on its rule list and label only, so samples are reduced
to distinct lists with their counts of both labels.  With mini-batches (``batch`` > 0) samples
keep their order (the column ``ord``), and each batch is one step; larger relations are clustered
by batch, so that a step reads its own batch.

Models: ``linear`` (a logistic model over fired rules) and ``surprisal`` (a noisy-or:
``1 - exp(-z)`` of the summed weights, ``gamma`` times those of fired pairs, and the
squared bias).  ``constrained`` weights are squares of what is fitted, so they are not
negative; otherwise a weight is what is fitted, and the surprisal model takes the
softplus of its sum.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, fields
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import saved

MODELS = ("linear", "surprisal")
REDUCTIONS = ("mean", "sum", "class_mean")
MAX_FEATURES = 5_000_000
WHOLE_VALUES = 20_000_000
BLOCK = 65_536
EPSILON = 1e-7


def phase_lengths(epochs: int, phases: int) -> list[int]:
    """Epochs of each phase: 40, 40 and 20 per cent of three, else evenly, the rest to the earliest."""
    if phases == 3:
        a = int(epochs * 0.4)
        return [a, a, epochs - 2 * a]
    return [epochs // phases + (k < epochs % phases) for k in range(phases)]


@dataclass(frozen=True)
class Setting:
    """How a fit goes.  ``bias`` None: drawn evenly within one over the root of the number of rules, by ``seed`` and relation."""

    model: str = "linear"
    epochs: int = 60
    rates: tuple[float, ...] = (0.01, 0.005, 0.001)
    positive_weight: float = 5.0
    constrained: bool = True
    reduction: str = "mean"
    bias: float | None = 0.0
    seed: int = 0
    batch: int = 0

    def __post_init__(self):
        if self.model not in MODELS:
            raise ValueError(f"model must be one of {MODELS}, not {self.model!r}")
        if self.reduction not in REDUCTIONS:
            raise ValueError(f"reduction must be one of {REDUCTIONS}, not {self.reduction!r}")

    def rate(self, epoch: int) -> float:
        """The rate of an epoch, from 0."""
        ends = np.cumsum(phase_lengths(self.epochs, len(self.rates)))
        return self.rates[int(np.searchsorted(ends, epoch, "right"))]

    def first_bias(self, p, rules: int) -> float:
        if self.bias is not None:
            return self.bias
        drawn = int(hashlib.sha256(f"{self.seed}:{p}".encode()).hexdigest()[:8], 16) / 2**32
        return (2 * drawn - 1) / np.sqrt(max(1, rules))

    def first_weights(self, given: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Initial effective weights from confidences of rules and lifts of pairs."""
        own = given if self.model == "linear" else -np.log1p(-np.minimum(given, 1 - EPSILON))
        return np.maximum(0.0, np.where(pair, given, own))

    def parameters(self, weights: np.ndarray) -> np.ndarray:
        return np.sqrt(weights) if self.constrained else weights

    def effective(self, x: np.ndarray) -> np.ndarray:
        return x * x if self.constrained else x


@dataclass
class Fitted:
    """``rules``: ``p, rule_id, original, trained``; ``pairs``: ``p, a, b, original, trained``; ``relations``: ``p, bias, gamma, first_loss, last_loss, epochs, status``; ``history``: ``p, direction, epoch`` and metrics."""

    rules: DataFrame
    pairs: DataFrame
    relations: DataFrame
    history: DataFrame | None = None


class Adam:
    """What is fitted, with Adam's moments; each number counts its own steps."""

    def __init__(self, x: np.ndarray):
        self.x, self.m, self.v, self.steps = x, np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)

    def step(self, g: np.ndarray, rate: float, moved: np.ndarray | None = None) -> None:
        """One step, of the numbers in ``moved`` alone if it is given."""
        at = np.flatnonzero(moved) if moved is not None else slice(None)
        self.steps[at] += 1
        self.m[at] = 0.9 * self.m[at] + 0.1 * g[at]
        self.v[at] = 0.999 * self.v[at] + 0.001 * g[at] * g[at]
        self.x = self.x.copy()
        self.x[at] -= rate * (self.m[at] / (1 - 0.9 ** self.steps[at])) / (np.sqrt(self.v[at] / (1 - 0.999 ** self.steps[at])) + 1e-8)


def gradient(s: Setting, x: np.ndarray, size: int, rel: np.ndarray, relations: int, rules: tuple, pairs: tuple, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """The summed gradient of samples by what is fitted (features, biases, gammas) and, last, their losses by relation.

    ``rules`` and ``pairs``: sample numbers and features; ``pos, neg``: the labels' weights of each sample.
    """
    (row, f), (prow, pf) = rules, pairs
    w, bias, gamma = s.effective(x[:size]), x[size : size + relations], x[size + relations :]
    pair_sum = np.bincount(prow, w[pf], len(rel))
    b = bias[rel]
    squared = s.constrained and s.model == "surprisal"
    z = np.bincount(row, w[f], len(rel)) + gamma[rel] * pair_sum + (b * b if squared else b)
    if s.model == "linear":
        pred = 1 / (1 + np.exp(-z))
        dz = neg * pred - pos * (1 - pred)
    else:
        slope = 1.0
        if not s.constrained:
            slope, z = 1 / (1 + np.exp(-z)), np.logaddexp(0, z)
        pred = np.clip(1 - np.exp(-z), EPSILON, 1 - EPSILON)
        dz = (neg - pos * (1 - pred) / pred) * slope
    pred = np.clip(pred, EPSILON, 1 - EPSILON)
    of_w = np.bincount(f, dz[row], size) + np.bincount(pf, (dz * gamma[rel])[prow], size)
    of_w = of_w * 2 * x[:size] if s.constrained else of_w
    rest = [dz * (2 * b if squared else 1.0), dz * pair_sum, -(pos * np.log(pred) + neg * np.log(1 - pred))]
    return np.concatenate([of_w, *[np.bincount(rel, r, relations) for r in rest]])


def _scales(s: Setting, pos, neg):
    """What a positive and a negative sample weigh, from how many of both a batch has."""
    one = np.maximum(1.0, {"mean": pos + neg, "sum": 1.0, "class_mean": 2 * pos}[s.reduction])
    two = np.maximum(1.0, {"mean": pos + neg, "sum": 1.0, "class_mean": 2 * neg}[s.reduction])
    return s.positive_weight / one, 1 / two


def _places(ids: pa.ChunkedArray, a: np.ndarray, b: np.ndarray, pair: np.ndarray) -> tuple[tuple, tuple]:
    """The features in each rule list: rules as rows and numbers, pairs as rows and numbers; unknown ids drop out."""
    lists = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    values = lists.flatten().to_numpy(zero_copy_only=False)
    number = np.flatnonzero(~pair)
    number = number[np.argsort(a[number], kind="stable")]
    at = np.minimum(np.searchsorted(a[number], values), max(0, len(number) - 1))
    known = a[number][at] == values if len(number) else np.zeros(len(values), bool)
    second: dict[int, list[tuple[int, int]]] = {}
    for n in np.flatnonzero(pair).tolist():
        second.setdefault(int(a[n]), []).append((int(b[n]), n))
    prow, pf = [], []
    if second:
        for k, held in enumerate(lists.to_pylist()):
            mine = set(held)
            found = [n for x in mine for y, n in second.get(x, ()) if y in mine]
            prow += [k] * len(found)
            pf += found
    return (row[known], number[at[known]] if len(number) else row[known]), (np.array(prow, int), np.array(pf, int))


def _slice(flat: tuple, begin: int, end: int) -> tuple:
    row, f = flat
    x, y = np.searchsorted(row, [begin, end])
    return row[x:y] - begin, f[x:y]


def _whole(runs: list[Setting], every: int):
    """A function that fits one relation in one task: its lists and its features to rows of weights and of figures."""

    def run(key, lists, given):
        p, out = key[0].as_py() if hasattr(key[0], "as_py") else key[0], []
        if given.num_rows == 0:
            return pa.table({n: pa.array([], t) for n, t in zip(_OUT, types(lists, given), strict=True)})
        order = np.argsort(lists.column("ord").to_numpy(), kind="stable")
        lists = lists.take(pa.array(order))
        a, b = given.column("a").to_numpy(), given.column("b").fill_null(-1).to_numpy()
        first, isp = given.column("w").to_numpy(), given.column("b").is_valid().to_numpy(zero_copy_only=False)
        flat, flat_pairs = _places(lists.column("ids"), a, b, isp)
        pos, neg = lists.column("pos").to_numpy(), lists.column("neg").to_numpy()
        size, n = len(a), len(pos)
        for number, s in enumerate(runs):
            start = s.first_weights(first, isp)
            adam = Adam(np.concatenate([s.parameters(start), [s.first_bias(p, int((~isp).sum())), 1.0]]))
            pairs = flat_pairs if s.model == "surprisal" else (np.empty(0, int), np.empty(0, int))
            step, losses = s.batch or max(1, n), []
            for epoch in range(s.epochs):
                seen = []
                for at in range(0, max(1, n), step):
                    end = min(n, at + step)
                    x, y = pos[at:end], neg[at:end]
                    one, two = _scales(s, x.sum(), y.sum())
                    g = gradient(s, adam.x, size, np.zeros(end - at, int), 1, _slice(flat, at, end), _slice(pairs, at, end), x * one, y * two)
                    seen.append(g[-1])
                    adam.step(g[:-1], s.rate(epoch))
                losses.append(float(np.mean(seen)))
                if epoch + 1 == s.epochs or every and (epoch + 1) % every == 0:
                    w = s.effective(adam.x[:size])
                    used = ~isp | (s.model == "surprisal")
                    out += [(number, epoch + 1, *v) for v in zip(a[used].tolist(), [int(v) if k else None for v, k in zip(b[used], isp[used], strict=True)], start[used].tolist(), w[used].tolist(), strict=True)]
                    out.append((number, epoch + 1, None, None, float(adam.x[size]), float(adam.x[size + 1])))
            out.append((number, 0, None, None, losses[0] if losses else 0.0, losses[-1] if losses else 0.0))
            out.append((number, -1, None, None, float((pos + neg).sum()), 0.0))
        columns = [list(c) for c in zip(*out, strict=True)]
        columns.insert(1, [p] * len(out))
        return pa.table({n: pa.array(c, t) for n, c, t in zip(_OUT, columns, types(lists, given), strict=True)})

    def types(lists, given):
        return (pa.int32(), given.schema.field("p").type, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    return run


#: Rows of a fit: weights of features (``a``, with ``b`` those of pairs) after an epoch, ``bias, gamma`` after it (no ``a``), losses (epoch 0) and samples (-1).
_OUT = ("run", "p", "epoch", "a", "b", "original", "trained")


def _in_batches(lists: DataFrame, batch: int) -> DataFrame:
    """``lists``, numbered as ``n``, with the ``batch`` of each within its relation.

    The first number of each relation is broadcast (relations that the driver holds anyway); by a shuffle all samples of a relation would meet in one task.
    """
    begins = lists.groupBy("p").agg(F.min("n").alias("_first"))
    return lists.join(F.broadcast(begins), "p").withColumn("batch", F.floor((F.col("n") - F.col("_first")) / batch).cast("int"))


def _distributed(lists: DataFrame, given: DataFrame, runs: list[Setting], every: int, kind: str) -> DataFrame:
    """The same rows for relations of any size, a job a step."""
    spark = lists.sparkSession
    rows = given.limit(MAX_FEATURES + 1).collect()
    if len(rows) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} rules and pairs of relations that are fitted distributed")
    rows.sort(key=lambda r: (r.p, r.a, r.b is not None, r.b or 0))
    relations = sorted({r.p for r in rows})
    a, b = np.array([r.a for r in rows]), np.array([-1 if r.b is None else r.b for r in rows])
    isp, first = np.array([r.b is not None for r in rows]), np.array([r.w for r in rows])
    ends = np.searchsorted([r.p for r in rows] if not isinstance(relations[0], str) else np.array([r.p for r in rows]), relations, "right").tolist()
    rel_of = np.repeat(np.arange(len(relations)), np.diff([0, *ends]))
    size, many = len(rows), len(relations)
    shared = spark.sparkContext.broadcast((a, b, isp, relations, ends))  # MAX_FEATURES at most

    def prepare(batches):
        a, b, isp, relations, ends = shared.value
        number = {p: n for n, p in enumerate(relations)}
        for batch in batches:
            p = batch.column("p").to_pylist()
            for name in dict.fromkeys(p):
                part = batch.filter(pa.array([x == name for x in p]))
                begin, end = ([0, *ends][number[name]], ends[number[name]])
                (row, f), (prow, pf) = _places(part.column("ids"), a[begin:end], b[begin:end], isp[begin:end])
                split = lambda r, v, n: pa.ListArray.from_arrays(pa.array(np.searchsorted(r, np.arange(n + 1)).astype("int32")), pa.array(v.astype("int32")))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, number[name], "int32")), part.column("batch"), split(row, f + begin, part.num_rows), split(prow, pf + begin, part.num_rows), part.column("pos"), part.column("neg")], ["rel", "batch", "rules", "pairs", "pos", "neg"])

    sized = {s.batch for s in runs}
    if len(sized) > 1:
        raise ValueError("the settings of one distributed fit share their batch size")
    batch = next(iter(sized))
    if batch:  # numbered over all relations, then from each relation's first
        from .graph import numbered

        lists = _in_batches(saved(numbered(lists, [F.col("p"), F.col("ord")], "n"), "ordered"), batch)
    else:
        lists = lists.withColumn("batch", F.lit(0))
    table = lists.select("p", "batch", "ids", "pos", "neg").mapInArrow(prepare, "rel int, batch int, rules array<int>, pairs array<int>, pos double, neg double")
    table = saved(table.repartitionByRange("batch", F.rand(1)).sortWithinPartitions("batch") if batch else table, "lists")
    counted = table.groupBy("rel", "batch").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()  # a row a relation and batch
    batches = 1 + max((r.batch for r in counted), default=0)
    pos, neg = np.zeros((batches, many)), np.zeros((batches, many))
    for r in counted:
        pos[r.batch, r.rel], neg[r.batch, r.rel] = r.pos, r.neg
    starts = [s.first_weights(first, isp) for s in runs]
    rules_of = np.bincount(rel_of[~isp], minlength=many)
    states = [Adam(np.concatenate([s.parameters(w), [s.first_bias(p, int(k)) for p, k in zip(relations, rules_of, strict=True)], np.ones(many)])) for s, w in zip(runs, starts, strict=True)]
    losses: list[list[np.ndarray]] = [[] for _ in runs]
    out, width = [], size + 3 * many

    def one_step(number: int, active: list[int]) -> np.ndarray:
        state = spark.sparkContext.broadcast([(runs[k], states[k].x, *_scales(runs[k], pos[number], neg[number])) for k in active])

        def run(parts):
            total = np.zeros((len(active), width))
            for part in parts:
                rel = part.column(0).to_numpy()
                flat = []
                for c in (1, 2):
                    lists = part.column(c)
                    flat.append((np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets))), lists.flatten().to_numpy()))
                x, y = part.column(3).to_numpy(), part.column(4).to_numpy()
                none = (np.empty(0, int), np.empty(0, int))
                for k, (s, at, one, two) in enumerate(state.value):
                    total[k] += gradient(s, at, size, rel, many, flat[0], flat[1] if s.model == "surprisal" else none, x * one[rel], y * two[rel])
            for begin in range(0, width, BLOCK):
                block = total[:, begin : begin + BLOCK]
                if block.any():
                    yield pa.RecordBatch.from_arrays([pa.array([begin], pa.int32()), pa.array([block.tobytes()])], ["begin", "sums"])

        def add(group):
            return pa.table({"begin": group.column("begin").slice(0, 1), "sums": [np.sum([np.frombuffer(x.as_py()) for x in group.column("sums")], axis=0).tobytes()]})

        sums = table.filter(F.col("batch") == number).select("rel", "rules", "pairs", "pos", "neg").mapInArrow(run, "begin int, sums binary").groupBy("begin").applyInArrow(add, "begin int, sums binary")
        total = np.zeros((len(active), width))
        for r in sums.collect():  # a row a block of features
            total[:, r.begin : r.begin + BLOCK] = np.frombuffer(r.sums).reshape(len(active), -1)
        state.destroy()
        return total

    for epoch in range(max(s.epochs for s in runs)):
        active = [k for k, s in enumerate(runs) if epoch < s.epochs]
        seen = np.zeros((batches, len(active), many))
        for number in range(batches):
            total = one_step(number, active)
            here = pos[number] + neg[number] > 0
            moved = None if here.all() or batches == 1 else np.concatenate([here[rel_of], here, here])  # relations without samples left take no step
            for n, k in enumerate(active):
                states[k].step(total[n, : size + 2 * many], runs[k].rate(epoch), moved)
                seen[number, n] = total[n, size + 2 * many :]
        had = np.maximum(1, (pos + neg > 0).sum(axis=0))
        for n, k in enumerate(active):
            losses[k].append(seen[:, n].sum(axis=0) / had)
            if epoch + 1 == runs[k].epochs or every and (epoch + 1) % every == 0:
                x = states[k].x
                used = ~isp | (runs[k].model == "surprisal")
                w = runs[k].effective(x[:size])
                out += [(k, rows[i].p, epoch + 1, int(a[i]), rows[i].b, float(starts[k][i]), float(w[i])) for i in np.flatnonzero(used)]
                out += [(k, p, epoch + 1, None, None, float(x[size + n]), float(x[size + many + n])) for n, p in enumerate(relations)]
    for k in range(len(runs)):
        for n, p in enumerate(relations):
            out.append((k, p, 0, None, None, float(losses[k][0][n]) if losses[k] else 0.0, float(losses[k][-1][n]) if losses[k] else 0.0))
            out.append((k, p, -1, None, None, float((pos + neg).sum(axis=0)[n]), 0.0))
    return spark.createDataFrame(out, f"run int, p {kind}, epoch int, a long, b long, original double, trained double")


def _fits(samples: DataFrame, rules: DataFrame, pairs: DataFrame | None, runs: list[Setting], every: int, whole_values: int) -> DataFrame:
    """The rows of :data:`_OUT` of all settings and relations that have rules."""
    kind = dict(rules.dtypes)["p"]
    given = rules.select("p", F.col("rule_id").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.col("conf").cast("double").alias("w"))
    if pairs is not None and any(s.model == "surprisal" for s in runs):
        given = given.unionByName(pairs.select("p", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("lift").cast("double").alias("w")))
    given = saved(given, "features")
    known = samples.select("p", F.col("rule_ids").cast("array<bigint>").alias("ids"), F.col("gold").cast("double").alias("gold"), *(["ord"] if any(s.batch for s in runs) else []))
    known = known.join(given.select("p").distinct(), "p", "left_semi")
    if any(s.batch for s in runs):
        lists = known.select("p", F.col("ord").cast("long").alias("ord"), "ids", F.col("gold").alias("pos"), (1 - F.col("gold")).alias("neg"))
    else:
        lists = known.groupBy("p", F.sort_array("ids").alias("ids")).agg(F.sum("gold").alias("pos"), F.sum(1 - F.col("gold")).alias("neg")).select("p", F.lit(0).cast("long").alias("ord"), "ids", "pos", "neg")
    lists = saved(lists, "lists")
    large = saved(lists.groupBy("p").agg(F.sum(F.size("ids") + 1).alias("n")).filter(F.col("n") > whole_values).select("p"), "large")
    out = lists.join(large, "p", "left_anti").groupBy("p").cogroup(given.join(large, "p", "left_anti").groupBy("p")).applyInArrow(_whole(runs, every), f"run int, p {kind}, epoch int, a long, b long, original double, trained double")
    if large.take(1):
        out = out.unionByName(_distributed(lists.join(large, "p", "left_semi"), given.join(large, "p", "left_semi"), runs, every, kind))
    return saved(out, "fits")


def _figures(fits: DataFrame, runs: list[Setting]) -> DataFrame:
    """``run, p, first_loss, last_loss, epochs, status`` of every relation."""
    loss = fits.filter("epoch = 0").select("run", "p", F.col("original").alias("first_loss"), F.col("trained").alias("last_loss"))
    count = fits.filter("epoch = -1").select("run", "p", F.when(F.col("original") > 0, "ok").otherwise("no samples").alias("status"))
    epochs = F.element_at(F.array(*[F.lit(s.epochs) for s in runs]), F.col("run") + 1)
    return loss.join(count, ["run", "p"]).withColumn("epochs", epochs)


def train(
    samples: DataFrame,
    rules: DataFrame,
    model: str = "linear",
    pairs: DataFrame | None = None,
    evaluate: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    every: int = 5,
    patience: int = 0,
    whole_values: int = WHOLE_VALUES,
    **options,
) -> Fitted:
    """Fit ``samples`` (``p, rule_ids, gold``, with mini-batches ``ord``) over ``rules`` (``p, rule_id, conf``) and ``pairs`` (``p, a, b, lift``; surprisal only).

    ``options`` are those of :class:`Setting`.  ``evaluate`` takes the tables ``p, rule_id, trained`` and ``p, bias, gamma``
    of every ``every`` epochs and the end, and returns ``p, direction, mrr``; the weights of a relation's best epoch
    (the mean over its directions, the earliest of equals) are kept, and with ``patience`` evaluation ends when no
    relation has risen in so many.  Types of ``p`` and ``rule_id`` are those of ``rules``.
    """
    s = Setting(model=model, **options)
    fits = _fits(samples, rules, pairs, [s], every if evaluate is not None else 0, whole_values)
    kind = dict(rules.dtypes)["rule_id"]
    weights, biases = fits.filter("a is not null and b is null"), fits.filter("a is null and epoch > 0").select("p", "epoch", F.col("original").alias("bias"), F.col("trained").alias("gamma"))
    best, history, ended = None, None, s.epochs
    if evaluate is not None:
        top: dict = {}
        seen, waited = [], 0
        for epoch in [*range(every, s.epochs, every), s.epochs]:
            at = F.col("epoch") == epoch
            found = evaluate(weights.filter(at).select("p", F.col("a").cast(kind).alias("rule_id"), "trained"), biases.filter(at).select("p", "bias", "gamma")).collect()  # a row for each relation and direction
            seen += [(r.p, r.direction, epoch, float(r.mrr)) for r in found]
            rose = False
            for p in {r.p for r in found}:
                got = [r.mrr for r in found if r.p == p]
                mean = sum(got) / len(got)
                if mean > top.get(p, (-1.0, 0))[0]:
                    top[p], rose = (mean, epoch), True
            waited = 0 if rose else waited + 1
            if patience > 0 and waited >= patience:
                ended = epoch
                break
        best = rules.sparkSession.createDataFrame([(p, e) for p, (_, e) in top.items()], f"p {dict(rules.dtypes)['p']}, _best int")
        history = rules.sparkSession.createDataFrame(seen, f"p {dict(rules.dtypes)['p']}, direction string, epoch int, mrr double")

    def chosen(df: DataFrame) -> DataFrame:
        if best is None:
            return df.filter(F.col("epoch") == s.epochs)
        return df.join(best, "p", "left").filter(F.col("epoch") == F.coalesce("_best", F.lit(ended))).drop("_best")

    own = chosen(weights).select("p", F.col("a").cast(kind).alias("rule_id"), "original", "trained")
    both = chosen(fits.filter("b is not null")).select("p", F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "original", "trained")
    summary = chosen(biases).join(_figures(fits, [s]), "p").select("p", "bias", "gamma", "first_loss", "last_loss", F.lit(ended).alias("epochs"), "status")
    return Fitted(own, both, summary, history)


def fit(samples: DataFrame, rules: DataFrame, model: str = "linear", **options) -> DataFrame:
    """``p, rule_id, original, trained, bias, first_loss, last_loss``: the rules' weights of :func:`train` with their relation's figures."""
    fitted = train(samples, rules, model, **options)
    return fitted.rules.join(fitted.relations, "p").select("p", "rule_id", "original", "trained", "bias", "first_loss", "last_loss")


def failed(fitted: Fitted, expected: DataFrame) -> DataFrame:
    """``p, error`` of the relations in ``expected`` (``p``) that have no fit, and why."""
    known = fitted.relations.select("p", "status")
    return expected.select("p").distinct().join(known, "p", "left").select("p", F.coalesce("status", F.lit("no rules")).alias("error")).filter("error <> 'ok'")


def grid(options: dict[str, list]) -> list[dict]:
    """Every combination of the options' values, the last option changing first."""
    return [dict(zip(options, values, strict=True)) for values in product(*options.values())]


def tuned(samples: DataFrame, rules: DataFrame, options: dict[str, list], pairs: DataFrame | None = None, whole_values: int = WHOLE_VALUES, **fixed) -> DataFrame:
    """``run, options, p`` and the figures of each relation, for each combination of a grid of :class:`Setting`'s options; one scan serves all runs."""
    chosen = grid(options)
    known = {f.name for f in fields(Setting)}
    runs = [Setting(**{k: v for k, v in {**c, **fixed}.items() if k in known}) for c in chosen]
    fits = _fits(samples, rules, pairs, runs, 0, whole_values)
    last = fits.filter("a is null and epoch > 0").select("run", "p", F.col("original").alias("bias"), F.col("trained").alias("gamma"))
    names = F.element_at(F.array(*[F.lit(json.dumps(c, sort_keys=True)) for c in chosen]), F.col("run") + 1)
    return last.join(_figures(fits, runs), ["run", "p"]).select("run", names.alias("options"), "p", "bias", "gamma", "first_loss", "last_loss", "epochs", "status")
