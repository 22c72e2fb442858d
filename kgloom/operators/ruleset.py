"""Applying a whole set of rules, given as text, to a graph: both directions, every shape.

A rule is turned into a chain of steps that begins at what a query fixes, once for each
direction: at the query's own entity (``h(X,Y) <= ...``, and ``h(X,c) <= ...`` asked for c), at
a constant of the body (``h(X,c) <= b(X,d)`` asked for X, begins at d), or anywhere (a body
that ends in a free variable, walked backwards).  Chains that begin alike share their
beginnings: all steps of all rules form a trie, and each depth of it is one join of what was
reached with the edges, for every rule at once.  Entities that were reached along a shared
beginning are found once, whatever the number of rules behind it.

A chain between two variables is walked from the end with fewer entities, and few starts walk
together as bits of blocks.  What was reached is dealt before rules are put to it, by query or, where a relation has few queries, by candidate.

Bodies are matched as they stand: different variables may stand for one entity.
Edges into or from hubs are dealt over many tasks (:mod:`kgloom.operators.skew`).

Defined results: a rule fires once for a query and candidate; queries that no rule answers
have no rows; rules without an arrow or with a switched-off shape are not applied; an active
rule whose body is no chain (a variable or constant met again on the way, an atom apart)
is an error; rules without a body answer the direction in which their variable is
given; repeated triples, rules and queries change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as rule
from ..store import saved
from . import skew
from .apply import BROADCAST_RULES, MAX_READINGS, capped, few, first_by_confidence
from .skew import dealt, hub_join

#: Kinds of a step: to all neighbours, to the constants that rules name, to nothing but whether there is a neighbour, and from anywhere.
WALK, CONST, DANGLING, ANY = "walk", "const", "dangling", "any"
STEP = "struct<rel:string,inv:boolean,kind:string>"
#: A node of the trie with at most so many starts walks from all of them together; of a relation with at most so many queries, answers are dealt by candidate.
FEW_STARTS = 10_000


def _constant(term: Column) -> Column:
    return ~term.rlike("^[A-Z]$")


def chains(rules: DataFrame) -> DataFrame:
    """``rules`` (``rule_id, rule`` and others) with ``head, shape, steps, last, ok``.

    ``steps`` goes from the head's variable (of two, the first) along the body, ``last`` is the term at
    its end, and ``ok`` says that the body is such a chain.
    """
    h, atoms = rule.head(F.col("rule")), F.when(rule.shape(F.col("rule")) == "zero", F.array().cast("array<struct<rel:string,x:string,y:string>>")).otherwise(rule.body(F.col("rule")))
    known = rules.select(*rules.columns, h.alias("head"), rule.shape(F.col("rule")).alias("shape"), atoms.alias("_atoms"))
    begin = F.when(_constant(F.col("head.x")), F.col("head.y")).otherwise(F.col("head.x"))

    def step(state, atom):
        forth, back = atom["x"] == state["at"], atom["y"] == state["at"]
        to = F.when(forth, atom["y"]).otherwise(atom["x"])
        one = F.struct(atom["rel"].alias("rel"), (~forth).alias("inv"), F.lit(WALK).alias("kind")).cast(STEP)
        good = state["ok"] & (forth | back) & ~F.array_contains(state["met"], to) & ~_constant(state["at"])
        return F.struct(to.alias("at"), F.concat(state["steps"], F.array(one)).alias("steps"), F.concat(state["met"], F.array(to)).alias("met"), good.alias("ok"))

    start = F.struct(begin.alias("at"), F.array().cast(f"array<{STEP}>").alias("steps"), F.array(begin).alias("met"), F.lit(True).alias("ok"))
    walked = known.withColumn("_walk", F.aggregate("_atoms", start, step))
    ends = F.when(F.col("shape") == "cyclic", F.col("_walk.at") == F.col("head.y")).when(F.col("shape").isin("u_c", "u_xxc"), _constant(F.col("_walk.at"))).when(F.col("shape").isin("u_d", "u_xxd"), ~_constant(F.col("_walk.at")) & (F.size("_atoms") > 0)).otherwise(True)
    # on its way a chain does not meet the other variable of its head
    met = (F.col("shape") == "cyclic") & F.array_contains(F.slice("_walk.met", 1, F.size("_walk.met") - 1), F.col("head.y"))
    return walked.select(*rules.columns, "head", "shape", F.col("_walk.steps").alias("steps"), F.col("_walk.at").alias("last"), F.coalesce(F.col("_walk.ok") & ends & ~met, F.lit(False)).alias("ok"))


def _turned(steps: Column) -> Column:
    return F.reverse(F.transform(steps, lambda s: F.struct(s["rel"].alias("rel"), (~s["inv"]).alias("inv"), s["kind"].alias("kind")).cast(STEP)))


def _kinds(steps: Column, kind: str, first: bool) -> Column:
    """The steps with the first or the last of this kind."""
    n = F.size(steps)
    return F.transform(steps, lambda s, i: F.struct(s["rel"].alias("rel"), s["inv"].alias("inv"), F.when(i == (F.lit(0) if first else n - 1), F.lit(kind)).otherwise(s["kind"]).alias("kind")).cast(STEP))


def oriented(found: DataFrame) -> DataFrame:
    """The chains once for each direction that they answer: ``rule_id, direction, p, begin, seed, steps, target, q, answer``.

    ``begin``: ``query``, ``seed`` (at the constant ``seed``) or ``any``; ``target``: the constant that the chain must end at;
    ``q``: the constant that the query must ask about; ``answer``: the candidate, ``=`` for the query's entity itself, null for the chain's end.
    """
    none = F.lit(None).cast("string")
    steps, last, fixed = F.col("steps"), F.col("last"), _constant(F.col("last"))
    subject = _constant(F.col("head.x"))  # h(c,Y)
    of_variable, of_constant = F.when(subject, "head").otherwise("tail"), F.when(subject, "tail").otherwise("head")
    constant = F.when(subject, F.col("head.x")).otherwise(F.col("head.y"))

    def row(direction, begin, steps, seed=none, target=none, q=none, answer=none):
        parts = (("direction", direction), ("begin", begin), ("seed", seed), ("steps", steps), ("target", target), ("q", q), ("answer", answer))
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in parts])

    tested = F.when(fixed, _kinds(steps, CONST, False)).otherwise(_kinds(steps, DANGLING, False))
    target = F.when(fixed, last)
    back = F.when(fixed, _turned(steps)).otherwise(_kinds(_turned(steps), ANY, True))
    ways = (
        F.when(F.col("shape") == "cyclic", F.array(row("tail", "query", steps), row("head", "query", _turned(steps))))
        .when(F.col("shape").isin("u_c", "u_d"), F.array(row(of_variable, "query", tested, target=target, answer=constant), row(of_constant, F.when(fixed, "seed").otherwise("any"), back, seed=target, q=constant)))
        .when(F.col("shape").isin("u_xxc", "u_xxd"), F.array(*[row(d, "query", tested, target=target, answer=F.lit("=")) for d in ("tail", "head")]))
        .otherwise(F.array(row(of_variable, "query", steps, answer=constant)))
    )
    return found.select("rule_id", F.col("head.rel").alias("p"), F.explode(ways).alias("w")).select("rule_id", "p", "w.*")


def trie(ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, parent, depth, rel, inv, kind`` of every beginning of a chain, and ``ways`` with the ``node`` of their end and the ``first`` node.

    Nodes are numbered once, when they are written.  A trie has a node for each step of each rule at most.
    """
    name = lambda steps: F.array_join(F.transform(steps, lambda s: F.concat_ws("\u0001", s["kind"], s["inv"].cast("string"), s["rel"])), "\u0002")
    walked = ways.filter(F.size("steps") > 0)
    places = walked.select("steps", F.explode(F.sequence(F.lit(1), F.size("steps"))).alias("depth"))
    places = places.select("depth", name(F.slice("steps", 1, F.col("depth"))).alias("name"), name(F.slice("steps", 1, F.col("depth") - 1)).alias("of"), F.element_at("steps", F.col("depth")).alias("s")).distinct()
    nodes = saved(places.withColumn("node", F.monotonically_increasing_id()), "trie")
    parent = nodes.select(F.col("name").alias("of"), F.col("node").alias("parent"))
    linked = nodes.join(parent, "of", "left").select("node", "parent", "depth", "s.rel", "s.inv", "s.kind")
    at = nodes.select("name", "node")
    ended = ways.withColumns({"name": name(F.col("steps")), "_first": name(F.slice("steps", 1, 1))}).join(at, "name", "left").join(at.select(F.col("name").alias("_first"), F.col("node").alias("first")), "_first", "left")
    return saved(linked, "nodes"), saved(ended.drop("name", "_first", "steps"), "ways")


def named(triples: DataFrame, steps: DataFrame) -> DataFrame:
    """The triples of the relations ``rel`` that steps name, written once; only these are read."""
    relations = [r.rel for r in steps.select("rel").distinct().limit(MAX_READINGS + 1).collect()]
    if len(relations) <= MAX_READINGS:
        triples = triples.filter(F.col("p").isin(relations))
    return saved(triples.select("s", "p", "o"), "triples")


def _edges(kept: DataFrame, nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """``rel, inv, kind, at, to`` of the edges that the trie asks for.

    Edges to all neighbours are the rows of ``kept`` (:func:`named`), read anew in either direction and not shuffled, so that repeated triples
    are repeated edges.  Steps to constants keep edges to those constants alone, steps to nothing and from anywhere one edge an entity; these are written, each once.
    """
    asked = nodes.select("rel", "inv", "kind").distinct()
    both = kept.select(F.col("p").alias("rel"), F.explode(F.array(F.struct(F.lit(False).alias("inv"), F.col("s").alias("at"), F.col("o").alias("to")), F.struct(F.lit(True).alias("inv"), F.col("o").alias("at"), F.col("s").alias("to")))).alias("e")).select("rel", "e.*")
    of = lambda some: both.join(few(some), ["rel", "inv"])
    walk = of(asked.filter(F.col("kind") == WALK)).select("rel", "inv", "kind", "at", "to")
    constants = ways.filter("target is not null").join(nodes.select("node", "rel", "inv"), "node").select("rel", "inv", F.lit(CONST).alias("kind"), F.col("target").alias("to")).distinct()
    fixed = both.join(few(constants), ["rel", "inv", "to"], "left_semi").select("rel", "inv", F.lit(CONST).alias("kind"), "at", "to")
    ends = of(asked.filter(F.col("kind").isin(DANGLING, ANY)))
    ends = ends.select("rel", "inv", "kind", F.when(F.col("kind") != ANY, F.col("at")).alias("at"), F.when(F.col("kind") != DANGLING, F.col("to")).alias("to"))
    return walk.unionByName(saved(fixed.unionByName(ends).distinct(), "ends"))


def packed(starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, x, block, bits, at`` of ``starts`` (``node, x``, each once), and the table ``block, bit, x`` of the blocks.

    The starts of nodes with at most ``FEW_STARTS`` walk together, 64 in a block, as bits of one row; ``x`` is null then.  Others
    walk alone, and their ``block`` is null.  The table of blocks has ``BROADCAST_RULES`` rows at most; if it had more, all walk alone.
    """
    many = starts.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > FEW_STARTS).select("node")
    together = saved(starts.join(many, "node", "left_anti"), "together")
    one = F.lit(1).cast("long")
    if together.limit(BROADCAST_RULES + 1).count() > BROADCAST_RULES:
        none = together.limit(0).select(one.alias("block"), F.lit(0).alias("bit"), "x")
        return starts.select("node", "x", F.lit(None).cast("long").alias("block"), one.alias("bits"), F.col("x").alias("at")), none
    number = F.row_number().over(Window.orderBy("x")) - 1  # few rows
    names = saved(together.select("x").distinct().withColumn("_n", number).select(F.floor(F.col("_n") / 64).alias("block"), (F.col("_n") % 64).alias("bit"), "x"), "blocks")
    alone = starts.join(many, "node", "left_semi").select("node", "x", F.lit(None).cast("long").alias("block"), one.alias("bits"), F.col("x").alias("at"))
    packs = together.join(F.broadcast(names), "x").select("node", F.lit(None).cast("string").alias("x"), "block", F.expr("shiftleft(1L, bit)").alias("bits"), F.col("x").alias("at"))
    return alone.unionByName(packs), names


def spread(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` (``x, block, bits`` and others) with a row for each start ``x``, as :func:`packed` names them."""
    rest = [c for c in rows.columns if c not in ("x", "block", "bits")]
    alone = rows.filter("block is null").select(*rest, "x")
    return alone.unionByName(rows.filter("block is not null").drop("x").join(F.broadcast(names), "block").filter("(shiftright(bits, bit) & 1) = 1").select(*rest, "x"))


def reached(nodes: DataFrame, ways: DataFrame, edges: DataFrame, queries: DataFrame, least_hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``node, x, block, bits, to``: what each node of the trie reaches from ``x`` or the starts of a block (both null if from anywhere), and the table of the blocks.

    ``queries``: ``direction, p, q``; chains begin at the entities that these ask about, at their constants, or at all
    that their first step leaves from (``far``).  A depth of the trie is one join with the edges.
    """
    asked = queries.select("direction", "p", "q").distinct()
    begins = ways.filter("begin = 'query' and first is not null").select("direction", "p", "first").distinct().join(asked, ["direction", "p"]).select(F.col("first").alias("node"), F.col("q").alias("x"))
    seeds = ways.filter("begin = 'seed'").select("direction", "p", "q", "first", "seed").join(asked, ["direction", "p", "q"], "left_semi").select(F.col("first").alias("node"), F.col("seed").alias("x"))
    firsts = ways.filter("begin = 'far'").select(F.col("first").alias("node")).distinct().join(nodes.select("node", "rel", "inv", "kind"), "node")
    far = edges.join(few(firsts), ["rel", "inv", "kind"]).select("node", F.col("at").alias("x"))
    starts, names = packed(saved(begins.unionByName(seeds).unionByName(far).filter("x is not null").distinct(), "starts"))
    frontier = starts
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    options = {} if least_hot is None else {"least_hot": least_hot}
    anywhere = nodes.filter(F.col("kind") == ANY).select("node", "rel", "inv").join(edges.filter(F.col("kind") == ANY), ["rel", "inv"]).select("node", F.lit(None).cast("string").alias("x"), F.lit(None).cast("long").alias("block"), F.lit(1).cast("long").alias("bits"), "to")
    steps, out = nodes.filter(F.col("kind") != ANY), None
    for depth in range(1, deepest + 1):
        here = saved(frontier.join(steps.filter(F.col("depth") == depth).select("node", "rel", "inv", "kind"), "node"), f"frontier{depth}")
        some = edges.join(few(steps.filter(F.col("depth") == depth).select("rel", "inv", "kind").distinct()), ["rel", "inv", "kind"], "left_semi")
        found = hub_join(here, some, ["rel", "inv", "kind", "at"], **options).groupBy("node", "x", "block", "to").agg(F.bit_or("bits").alias("bits")).select("node", "x", "block", "bits", "to")
        found = saved(found.unionByName(anywhere) if depth == 1 else found, f"reached{depth}")
        out = found if out is None else out.unionByName(found)
        children = nodes.filter(F.col("depth") == depth + 1).select(F.col("parent").alias("node"), F.col("node").alias("child"))
        frontier = found.join(children, "node").select(F.col("child").alias("node"), "x", "block", "bits", F.col("to").alias("at"))
    return out if out is not None else frontier.select("node", "x", "block", "bits", F.col("at").alias("to")), names


def shorter(ways: DataFrame, kept: DataFrame, asked: DataFrame) -> DataFrame:
    """``ways`` of :func:`oriented`, those between two variables from the end with fewer entities.

    Where a chain's last step can end at fewer entities than are asked about, it is walked back from all of these, and
    begins ``far``.  The counts are estimates that change no result.
    """
    last = F.try_element_at("steps", F.lit(-1))
    ends = kept.groupBy(F.col("p").alias("_rel")).agg(F.approx_count_distinct("s").alias("_s"), F.approx_count_distinct("o").alias("_o"))  # a row a relation
    rows = ways.withColumn("_rel", last["rel"]).join(F.broadcast(ends), "_rel", "left").join(F.broadcast(asked.groupBy("direction", "p").agg(F.count("*").alias("_n"))), ["direction", "p"], "left")
    pairs = (F.col("begin") == "query") & F.col("answer").isNull() & F.col("target").isNull()
    far = F.coalesce(pairs & (F.when(last["inv"], F.col("_s")).otherwise(F.col("_o")) < F.col("_n")), F.lit(False))
    return rows.select(*[F.when(far, "far").otherwise(F.col(c)).alias(c) if c == "begin" else F.when(far, _turned(F.col(c))).otherwise(F.col(c)).alias(c) if c == "steps" else c for c in ways.columns])


@dataclass
class _Ends:
    """``rows``: ``kind, direction, p, node, m, q, cand``, what queries reached, before rules are put to it; ``q`` or ``cand`` is null where rules name it.

    ``ways``: ``kind, direction, p, node, m, rule_id, _q, answer``; ``sides``: ``direction, p, wide``, whether a relation has so few
    queries that rows are dealt by candidate; ``once``: no rule fires twice for a query and candidate.
    """

    rows: DataFrame
    ways: DataFrame
    sides: DataFrame
    once: bool

    def fired(self, rows: DataFrame) -> DataFrame:
        """``direction, p, q, cand, rule_id`` and other columns of ``rows``; there are many rules to an end."""
        rest = [c for c in rows.columns if c not in self.rows.columns]
        q = F.coalesce("q", "_q")
        return rows.join(few(self.ways), ["kind", "direction", "p", "node", "m"]).select("direction", "p", q.alias("q"), F.when(F.col("answer") == "=", q).otherwise(F.coalesce("cand", "answer")).alias("cand"), "rule_id", *rest)

    def by(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the entity ``_by`` that they are dealt by: the query, or the candidate if a relation has few queries."""
        return rows.join(F.broadcast(self.sides), ["direction", "p"]).withColumn("_by", F.when(F.col("wide"), F.col("cand")).otherwise(F.col("q"))).drop("wide")

    def tasks(self) -> int:
        """How many partitions hold ``ROWS_A_TASK`` of the rows that fire each; those that the session sets at least."""
        keys = ["kind", "direction", "p", "node", "m"]
        n = [rows.groupBy(*keys).agg(F.count("*").alias(name)) for rows, name in ((self.rows, "_n"), (self.ways, "_k"))]
        total = n[0].join(n[1], keys).agg(F.sum(F.col("_n") * F.col("_k"))).first()[0] or 0
        return max(int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // skew.ROWS_A_TASK))


def _ends_of(rules: DataFrame, triples: DataFrame, queries: DataFrame, least_hot: int | None = None) -> _Ends:
    found = saved(chains(rules.select("rule_id", "rule").distinct()), "chains")
    bad = found.filter(~F.col("ok")).select("rule_id", "rule").limit(5).collect()
    if bad:
        raise ValueError(f"rules whose body is no chain: {', '.join(f'{r.rule_id}: {r.rule}' for r in bad)}")
    once = found.groupBy("rule_id").count().filter("count > 1").isEmpty()
    asked = saved(queries.select("direction", "p", "q").distinct(), "asked")
    kept = named(triples, found.select(F.explode("steps.rel").alias("rel")))
    nodes, ways = trie(shorter(oriented(found), kept, asked))
    got, names = reached(nodes, ways, _edges(kept, nodes, ways), asked, least_hot)
    keys, end = ["direction", "p"], F.coalesce("node", F.lit(-1).cast("long")).alias("node")
    none, bare = F.lit(None).cast("string"), F.col("node").isNull()
    rest = saved(ways.filter("begin in ('seed', 'any')").join(asked, [*keys, "q"], "left_semi").withColumn("m", F.coalesce("seed", F.lit(""))), "rest")
    own = ways.filter("begin = 'query'").withColumn("kind", F.when(bare, "bare").when(F.col("answer").isNull(), "pair").otherwise("test"))
    far = ways.filter("begin = 'far'")
    row = lambda df, kind, m, q, cand: df.select(F.lit(kind).alias("kind") if isinstance(kind, str) else kind, *keys, end, m.alias("m"), q.alias("q"), cand.alias("cand"))

    mine = spread(got.join(few(own.filter(~bare).select("node", *keys, "kind").distinct()), "node"), names).join(asked.withColumnRenamed("q", "x"), [*keys, "x"], "left_semi")
    pair, x, to, blank = F.col("kind") == "pair", F.col("x"), F.col("to"), F.lit("")
    rows = row(mine, F.col("kind"), F.when(pair, "").otherwise(F.coalesce(to, blank)), x, F.when(pair, to))
    seeded = spread(got.join(few(rest.select("node").distinct()), "node", "left_semi"), names).withColumn("m", F.coalesce(x, blank))
    rows = rows.unionByName(row(seeded.join(few(rest.select("node", "m", *keys).distinct()), ["node", "m"]), "seed", F.col("m"), none, to))
    back = got.join(few(far.select("node", *keys).distinct()), "node").join(asked.withColumnRenamed("q", "to"), [*keys, "to"], "left_semi")
    rows = rows.unionByName(row(spread(back, names), "pair", blank, to, x))
    rows = rows.unionByName(row(asked.join(few(own.filter(bare).select(*keys).distinct()), keys, "left_semi").withColumn("node", F.lit(None).cast("long")), "bare", blank, F.col("q"), none))

    way = lambda df, kind, m, q: df.select(kind.alias("kind"), *keys, end, m.alias("m"), "rule_id", q.alias("_q"), "answer")
    put = way(own, F.col("kind"), F.when(F.col("kind") == "test", F.coalesce("target", blank)).otherwise(blank), none).unionByName(way(far, F.lit("pair"), blank, none)).unionByName(way(rest, F.lit("seed"), F.col("m"), F.col("q")))
    sides = asked.groupBy(*keys).agg((F.count("*") <= FEW_STARTS).alias("wide"))
    return _Ends(saved(rows, "reached"), saved(put, "put"), saved(sides, "sides"), once)


def fired(rules: DataFrame, triples: DataFrame, queries: DataFrame, least_hot: int | None = None) -> DataFrame:
    """``direction, p, q, cand, rule_id`` of all rules (``rule_id, rule``) and queries (``direction, p, q``)."""
    ends = _ends_of(rules, triples, queries, least_hot)
    every = ends.fired(ends.rows)
    return every if ends.once else every.distinct()  # a rule has one way a direction, and a way reaches an end once


def of_asked(known: DataFrame, queries: DataFrame) -> DataFrame:
    """The known answers of relations that queries ask about; these, a few, become a constant filter that drops the scans of all others."""
    asked = [r.p for r in queries.select("p").distinct().limit(MAX_READINGS + 1).collect()]
    return known.filter(F.col("p").isin(asked)) if len(asked) <= MAX_READINGS else known


def ended(got: DataFrame, ways: DataFrame, keys: list[str]) -> DataFrame:
    """``got`` (``keys``, ``to`` and others) with the ways that end there; a way's ``target`` is a key of the join, so ways to other constants yield no rows."""
    fixed = got.join(ways.filter("target is not null").withColumn("to", F.col("target")), [*keys, "to"])
    return fixed.unionByName(got.join(ways.filter("target is null"), keys))


def apply_rules(
    rules: DataFrame,
    triples: DataFrame,
    queries: DataFrame,
    known: DataFrame | None = None,
    topk: int = 100,
    top_rules: int = 200,
    shapes: tuple[str, ...] = ("cyclic", "u_c", "u_xxc", "u_xxd"),
    least_support: int = 5,
    longest: int = 3,
    target: str | None = None,
) -> DataFrame:
    """``direction, p, q, cand, pos, confs, rule_ids``: the first ``topk`` candidates of each query and the rules that give them.

    ``rules``: of :func:`kgloom.operators.rules.from_lines`; ``shapes``, ``least_support`` and ``longest`` say which are
    applied.  ``known`` (``direction, p, q, a``): answers that are left out of the candidates, but for that in the
    queries' column ``target``, if it is named.  Candidates are compared by their confidences, largest first; then by name.
    """
    active = saved(rules.filter(rule.is_active(F.col("rule"), F.col("num_true"), shapes, least_support, least_support, longest)).select("rule_id", "rule", "conf").distinct(), "active")
    keys = ["direction", "p", "q"]
    ends = _ends_of(active, triples, queries)
    rows, tasks = ends.by(ends.rows), ends.tasks()
    # ends are dealt before rules are put to them, but for those whose place rules name
    early = ends.fired(dealt(rows.filter("_by is not null"), tasks, "_by"))
    late = dealt(ends.by(ends.fired(rows.filter("_by is null").drop("_by"))), tasks, "_by")
    found = early.unionByName(late).join(few(active.select("rule_id", "conf")), "rule_id").withColumn("what", F.lit(0))
    found = found if ends.once else found.distinct()
    none = {"rule_id": F.lit(None).cast(dict(found.dtypes)["rule_id"]), "conf": F.lit(None).cast(dict(found.dtypes)["conf"])}
    given = []
    if known is not None:
        given.append(of_asked(known, queries).select(*keys, F.col("a").alias("cand"), F.lit(1).alias("what")))
    if known is not None and target is not None:
        given.append(queries.select(*keys, F.col(target).alias("cand"), F.lit(2).alias("what")))
    for told in given:
        found = found.unionByName(dealt(ends.by(told.dropna(subset=[*keys, "cand"])), tasks, "_by").withColumns(none))
    rule_of = F.when(F.col("what") == 0, F.struct("conf", (-F.col("rule_id")).alias("r")))
    by = found.groupBy("_by", *keys, "cand").agg(F.sort_array(F.collect_list(rule_of), asc=False).alias("f"), F.max(F.col("what") == 1).alias("_known"), F.max(F.col("what") == 2).alias("_target"))
    by = by.filter((F.size("f") > 0) & (~F.col("_known") | F.col("_target")))
    return capped(capped(first_by_confidence(by.select(*keys, "cand", "f"), keys, topk), top_rules), top_rules, "confs").select(*keys, "cand", F.col("pos").cast("long").alias("pos"), "confs", "rule_ids")
