"""Which rules predict given triples: chains met in the middle.

A target ``(s, p, o)`` fixes both ends of a body, so a chain need not be walked from one end
to the other.  Every chain between two variables is cut into a first half, a middle step
and a second half: the first half is walked from the subjects, the second backwards from
the objects.  Of the two ends of a relation's targets, that with fewer entities is then carried over the
middle step, and the other half, which carries a target by then, meets it there; so no pairs of
two large ends are ever made, and a hub in the middle yields none that nobody asked about.  Bodies that end in a
constant or a free variable are tested from the end that the target gives them.

Halves and tests share their beginnings in one trie, as in :mod:`kgloom.operators.ruleset`,
whose results on rules and triples hold here too; targets need not be in the graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import saved
from .apply import BROADCAST_RULES, few
from .ruleset import WALK, _edges, _turned, chains, ended, named, oriented, reached, spread, trie
from .skew import hub_join


def halves(found: DataFrame) -> DataFrame:
    """``rule_id, p, fore, mid, back`` of chains between two variables; ``back`` goes backwards from the head's second variable."""
    n = F.size("steps")
    fore = F.floor((n - 1) / 2).cast("int")
    rows = found.filter("shape = 'cyclic'")
    return rows.select("rule_id", F.col("head.rel").alias("p"), F.slice("steps", 1, fore).alias("fore"), F.element_at("steps", fore + 1).alias("mid"), _turned(F.slice("steps", fore + 2, n)).alias("back"))


def reduced_edges(middle: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The edges ``rel, inv, at, to`` whose ``at`` was reached in ``left`` and whose ``to`` in ``right`` (``rel, inv`` and the end)."""
    one = middle.join(left.select("rel", "inv", "at").distinct(), ["rel", "inv", "at"], "left_semi")
    return one.join(right.select("rel", "inv", "to").distinct(), ["rel", "inv", "to"], "left_semi")


def explained(rules: DataFrame, triples: DataFrame, targets: DataFrame, least_hot: int | None = None) -> DataFrame:
    """``s, p, o, rule_id`` of each target (``s, p, o``) and rule (``rule_id, rule``) that predicts it."""
    found = saved(chains(rules.select("rule_id", "rule")), "chains")
    bad = found.filter(~F.col("ok")).select("rule_id", "rule").limit(5).collect()
    if bad:
        raise ValueError(f"rules whose body is no chain: {', '.join(f'{r.rule_id}: {r.rule}' for r in bad)}")
    asked = saved(targets.select("s", "p", "o").distinct(), "targets")
    cut = saved(halves(found), "halves")
    none = F.lit(None).cast("string")
    sides = [cut.select("rule_id", "p", F.lit(d).alias("direction"), F.lit("query").alias("begin"), none.alias("seed"), F.col(side).alias("steps"), none.alias("target"), none.alias("q"), F.lit(side).alias("answer")) for side, d in (("fore", "tail"), ("back", "head"))]
    tests = oriented(found.filter("shape <> 'cyclic'")).filter("begin = 'query'")
    nodes, ways = trie(tests.withColumn("part", F.lit("test")).unionByName(sides[0].unionByName(sides[1]).withColumn("part", F.col("answer"))))
    middle_steps = cut.select("mid.rel", "mid.inv", F.lit(None).cast("long").alias("node"), "mid.kind").distinct()
    kept = named(triples, nodes.select("rel").unionByName(middle_steps.select("rel")))
    edges = _edges(kept, nodes.select("node", "rel", "inv", "kind").unionByName(middle_steps), ways)
    queries = asked.select(F.lit("tail").alias("direction"), "p", F.col("s").alias("q")).unionByName(asked.select(F.lit("head").alias("direction"), "p", F.col("o").alias("q"))).distinct()
    got, names = reached(nodes, ways, edges, queries, least_hot)

    # rules with a constant or a free variable at the end: a target is put to the ends that its entity reached, then to the rules that answer it
    test = ways.filter("part = 'test'").select("rule_id", "p", "direction", "node", "target", "answer")
    given = asked.select("p", F.explode(F.array(F.struct(F.lit("tail").alias("direction"), F.col("s").alias("x"), F.col("o").alias("answer")), F.struct(F.lit("head").alias("direction"), F.col("o").alias("x"), F.col("s").alias("answer")))).alias("t")).select("p", "t.*")
    keys = ["p", "direction", "answer"]
    constant, own = test.filter("answer <> '='"), test.filter("answer = '='").drop("answer")
    to_constant = given.join(few(constant.select(*keys).distinct()), keys, "left_semi")
    tested = _tested(got, names, constant, to_constant, ["node", *keys]).unionByName(_tested(got, names, own, given.filter("answer = x"), ["node", "p", "direction"]))
    tested = tested.unionByName(to_constant.join(few(constant.filter("node is null").drop("node", "target")), keys).select("rule_id", "p", "direction", "x", "answer"))
    head = F.col("direction") == "head"
    tested = tested.select(F.when(head, F.col("answer")).otherwise(F.col("x")).alias("s"), "p", F.when(head, F.col("x")).otherwise(F.col("answer")).alias("o"), "rule_id")

    # chains between two variables: links of a first half, a middle step and a second half
    ends = {side: ways.filter(f"part = '{side}'").select("rule_id", F.coalesce("node", F.lit(-1)).alias(side)) for side in ("fore", "back")}
    rows = cut.select("rule_id", "p", "mid.rel", "mid.inv").join(ends["fore"], "rule_id").join(ends["back"], "rule_id")
    sizes = asked.groupBy("p").agg(F.approx_count_distinct("s").alias("_s"), F.approx_count_distinct("o").alias("_o"))
    rows = saved(rows.join(F.broadcast(sizes), "p", "left").withColumn("carried", F.when(F.col("_s") < F.col("_o"), "s").otherwise("o")).drop("_s", "_o"), "links")
    links = rows.drop("rule_id").distinct()
    chained = None
    for carried in ("o", "s"):
        some = links.filter(F.col("carried") == carried).drop("carried")
        if not some.isEmpty():
            met = _met(asked, got, names, edges, some, carried, least_hot).join(few(rows.drop("carried")), ["p", "rel", "inv", "fore", "back"]).select("s", "p", "o", "rule_id")
            chained = met if chained is None else chained.unionByName(met)
    return (tested if chained is None else tested.unionByName(chained)).distinct()


def _tested(got: DataFrame, names: DataFrame, ways: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """``rule_id, p, direction, x, answer`` of the ``given`` targets whose entity ``x`` reached the end of a way."""
    of = ways.filter("node is not null")
    here = spread(got.join(few(of.select("node", "p", "direction").distinct()), "node"), names).join(given, ["p", "direction", "x"])
    return ended(here, few(of), keys).select("rule_id", "p", "direction", "x", "answer")


def _met(asked: DataFrame, got: DataFrame, names: DataFrame, edges: DataFrame, links: DataFrame, carried: str, least_hot: int | None) -> DataFrame:
    """``s, p, o, rel, inv, fore, back`` of the targets and ``links`` (``p, rel, inv, fore, back``) whose halves meet.

    The end ``carried`` of the targets is carried over the middle step, in blocks as it was walked; the half of the other end is joined
    with its targets, and meets what was carried at its own end of the step.
    """
    far, near = ("back", "fore") if carried == "o" else ("fore", "back")
    other, (inner, outer) = {"o": ("s", ("to", "at")), "s": ("o", ("at", "to"))}[carried]
    bare = F.lit(-1).cast("long")
    # the carried half, over the step
    begun = asked.join(few(links.filter(F.col(far) < 0).select("p").distinct()), "p", "left_semi").select(F.col(carried).alias("x")).distinct()
    begun = begun.select(bare.alias("node"), "x", F.lit(None).cast("long").alias("block"), F.lit(1).cast("long").alias("bits"), F.col("x").alias("to"))
    step = ["rel", "inv", inner]
    half = got.unionByName(begun).withColumnsRenamed({"node": far, "to": inner}).join(few(links.select(far, "rel", "inv").distinct()), far)
    middle = edges.filter(F.col("kind") == WALK).select("rel", "inv", "at", "to").join(few(links.select("rel", "inv").distinct()), ["rel", "inv"], "left_semi")
    half = saved(half, far)
    # the other half, with its targets
    whole = asked.join(F.broadcast(names.withColumnRenamed("x", carried)), carried, "left")
    begun = whole.join(few(links.filter(F.col(near) < 0).select("p").distinct()), "p", "left_semi").select(bare.alias(near), "p", "s", "o", "block", "bit", F.col(other).alias(outer))
    mine = spread(got.withColumnsRenamed({"node": near, "to": outer}).join(few(links.select("p", near).distinct()), near), names).withColumnRenamed("x", other)
    mine = mine.join(whole, ["p", other]).select(near, "p", "s", "o", "block", "bit", outer).unionByName(begun).join(few(links), ["p", near])
    if asked.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:  # few targets reach few of the edges
        ends = {outer: mine, inner: half}
        middle = saved(reduced_edges(middle, ends["at"], ends["to"]), "middle")
    options = {} if least_hot is None else {"least_hot": least_hot}
    over = hub_join(half, middle, step, **options).groupBy("rel", "inv", far, "x", "block", outer).agg(F.bit_or("bits").alias("bits"))
    same, columns, met = ["rel", "inv", far, outer], ["s", "p", "o", "rel", "inv", "fore", "back"], []
    if not half.filter("block is null").isEmpty():
        met.append(mine.join(over.filter("block is null").withColumnRenamed("x", carried), [*same, carried], "left_semi"))
    if not half.filter("block is not null").isEmpty():
        met.append(mine.filter("block is not null").join(over.filter("block is not null").drop("x"), [*same, "block"]).filter("(shiftright(bits, bit) & 1) = 1"))
    met = [m.select(*columns) for m in met] or [mine.select(*columns).limit(0)]
    return reduce(DataFrame.unionByName, met).distinct()
