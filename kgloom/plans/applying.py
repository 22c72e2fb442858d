"""Queries that apply and explain with a whole rule file, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import explain, graph, rules, ruleset, run, samples
from ..sources import formats
from ..store import saved, tables_dir
from .catalogue import joined, long, query

#: A rule file: families of lines made from the tables' rows.  ``{S}`` is the engine's string type; ``k1, k2`` order the lines of a family.
_FIXED = (
    "cust_nation(X,Y) <= ordered_by(A,X), shipped_by(A,B), supp_nation(B,Y)",
    "supp_nation(X,Y) <= shipped_by(A,X), ordered_by(A,B), cust_nation(B,Y)",
    "supp_nation(X,Y) <= supplied_by(A,X), supplied_by(A,B), supp_nation(B,Y)",
    "in_region(X,Y) <= cust_nation(A,X), cust_nation(A,B), in_region(B,Y)",
    "in_region(X,Y) <= supp_nation(A,X), supp_nation(A,B), in_region(B,Y)",
    "in_segment(X,Y) <= ordered_by(A,X), ordered_by(A,B), in_segment(B,Y)",
)
_LINES = """select 1 as fam, n_nationkey as k1, seg as k2, 20 + n_nationkey * 3 as preds, 3 + n_nationkey % 7 + length(seg) % 3 as num_true, 'cust_nation(X,n:' || cast(n_nationkey as {S}) || ') <= in_segment(X,m:' || seg || ')' as rule from nation cross join (select distinct c_mktsegment as seg from customer) sg
 union all select 2, n_nationkey, '', 100 + n_nationkey, 6 + n_nationkey, 'cust_nation(X,n:' || cast(n_nationkey as {S}) || ') <= ordered_by(A,X)' from nation
 union all select 3, n_nationkey, '', 30, 6 + n_nationkey % 5, 'in_region(n:' || cast(n_nationkey as {S}) || ',Y) <= in_region(A,Y)' from nation
 union all select 4, n_nationkey, '', 12, 2 + n_nationkey % 9, 'in_region(n:' || cast(n_nationkey as {S}) || ',Y) <= in_region(n:' || cast((n_nationkey + 1) % 25 as {S}) || ',Y)' from nation
 union all select 5, min(p_size), p_brand || p_type, 10 + min(p_size), 4 + min(p_size) % 11, 'has_brand(X,b:' || p_brand || ') <= has_type(X,t:' || p_type || ')' from part group by p_brand, p_type
 union all select 6, n_nationkey, '', 9, 6, 'supp_nation(X,X) <= supp_nation(X,n:' || cast(n_nationkey as {S}) || ')' from nation
 union all select 7, 0, '', 90, 7, 'cust_nation(X,X) <= in_segment(X,A)' from region where r_regionkey = 0
 union all select 8, r_regionkey, '', 50, 5 + r_regionkey, 'in_region(X,r:' || cast(r_regionkey as {S}) || ') <= ' from region
 union all """ + " union all ".join(f"select 9, {n}, '', {40 + n}, {20 + n}, '{text}' from region where r_regionkey = 0" for n, text in enumerate(_FIXED))
_TARGETS = ("cust_nation", "supp_nation", "in_region", "in_segment", "has_brand")
SHAPES = ("cyclic", "u_c", "u_d", "zero", "u_xxc", "u_xxd")

_STEPS = {
    0: "select a.o as x, c.o as y from t a join t b on b.s = a.s join t c on c.s = b.o where a.p = 'ordered_by' and b.p = 'shipped_by' and c.p = 'supp_nation'",
    1: "select a.o, c.o from t a join t b on b.s = a.s join t c on c.s = b.o where a.p = 'shipped_by' and b.p = 'ordered_by' and c.p = 'cust_nation'",
    2: "select a.o, c.o from t a join t b on b.s = a.s join t c on c.s = b.o where a.p = 'supplied_by' and b.p = 'supplied_by' and c.p = 'supp_nation'",
    3: "select a.o, c.o from t a join t b on b.s = a.s join t c on c.s = b.o where a.p = 'cust_nation' and b.p = 'cust_nation' and c.p = 'in_region'",
    4: "select a.o, c.o from t a join t b on b.s = a.s join t c on c.s = b.o where a.p = 'supp_nation' and b.p = 'supp_nation' and c.p = 'in_region'",
    5: "select a.o, c.o from t a join t b on b.s = a.s join t c on c.s = b.o where a.p = 'ordered_by' and b.p = 'ordered_by' and c.p = 'in_segment'",
}
#: The predictions ``rule_id, x, y`` of each family, from its columns and not from its text.
_PREDICTED = """select rule_id, t.s as x, 'n:' || cast(k1 as varchar) as y from r join t on t.p = 'in_segment' and t.o = 'm:' || k2 where fam = 1
 union select rule_id, t.o, 'n:' || cast(k1 as varchar) from r join t on t.p = 'ordered_by' where fam = 2
 union select rule_id, 'n:' || cast(k1 as varchar), t.o from r join t on t.p = 'in_region' where fam = 3
 union select rule_id, 'n:' || cast(k1 as varchar), t.o from r join t on t.p = 'in_region' and t.s = 'n:' || cast((k1 + 1) % 25 as varchar) where fam = 4
 union select rule_id, t.s, 'b:' || b.p_brand from r join (select distinct p_brand, p_type from part) b on k2 = b.p_brand || b.p_type join t on t.p = 'has_type' and t.o = 't:' || b.p_type where fam = 5
 union select rule_id, t.s, t.s from r join t on t.p = 'supp_nation' and t.o = 'n:' || cast(k1 as varchar) where fam = 6
 union select rule_id, t.s, t.s from r join t on t.p = 'in_segment' where fam = 7
 union """ + " union ".join(f"select rule_id, x, y from r join ({sql}) z(x, y) on true where fam = 9 and k1 = {n}" for n, sql in _STEPS.items())
_RULES = f"""t as materialized (select * from triples),
 r as (select * from (select row_number() over (order by fam, k1, k2) as rule_id, *, split_part(rule, '(', 1) as p, num_true / (preds + 5) as conf from ({_LINES.format(S='varchar')})) where num_true >= 5),
 ask as (select direction, p, q from (select 'tail' as direction, p, s as q from t union select 'head', p, o from t) where p in {_TARGETS}),
 kn as (select 'tail' as direction, p, s as q, o as cand from t where (length(s) * 3 + length(o)) % 4 > 0 union select 'head', p, o, s from t where (length(s) * 3 + length(o)) % 4 > 0),
 pr as materialized ({_PREDICTED}),
 fr as (select 'tail' as direction, r.p, x as q, y as cand, rule_id, conf from pr join r using (rule_id) union all select 'head', r.p, y, x, rule_id, conf from pr join r using (rule_id)
  union all select 'tail', r.p, q, 'r:' || cast(k1 as varchar), rule_id, conf from r join ask on ask.p = r.p and ask.direction = 'tail' where fam = 8),
 fk as materialized (select * from fr semi join ask using (direction, p, q))"""


def rule_file(spark, d):
    """The lines ``line, value`` of the rule file."""
    for t in ("nation", "region", "customer", "part"):
        graph.read(spark, d, t).createOrReplaceTempView(f"_rules_{t}")
    sql = _LINES.format(S="string")
    for t in ("nation", "region", "customer", "part"):
        sql = sql.replace(f"from {t}", f"from _rules_{t}")
    ordered = graph.numbered(spark.sql(sql), [F.col("fam"), F.col("k1"), F.col("k2")], "line")
    return ordered.select((F.col("line") + 1).alias("line"), F.concat_ws("\t", F.col("preds").cast("string"), F.col("num_true").cast("string"), F.lit("0.1"), "rule").alias("value"))


def _asked(triples):
    return graph.answers(triples.filter(F.col("p").isin(*_TARGETS))).select("direction", "p", "q").distinct()


def _known(triples):
    return graph.answers(triples.filter((F.length("s") * 3 + F.length("o")) % 4 > 0))


@query(f""", {_RULES},
 un as (select * from fk anti join kn using (direction, p, q, cand)),
 bc as (select direction, p, q, cand, list(conf order by conf desc) as l, list(rule_id order by conf desc, rule_id) as ids from un group by all),
 rk as (select *, row_number() over (partition by direction, p, q order by l desc, cand) as pos from bc)
 select direction, p, q, cand, pos, round(l[1], 9) as best, array_to_string(ids[1:5], ',') as ids from rk where pos <= 10""")
def rule_apply_file(spark, d):
    """A rule file of all shapes, read, filtered and applied to every query of five relations, in both directions; the first ten candidates with five rules."""
    triples = graph.projected(spark, d)
    loaded = rules.from_lines(rule_file(spark, d))
    found = ruleset.apply_rules(loaded, triples, _asked(triples), _known(triples), topk=10, top_rules=5, shapes=SHAPES, least_support=5, longest=3)
    return found.select("direction", "p", "q", "cand", long("pos"), F.round(F.col("confs")[0], 9).alias("best"), joined("rule_ids").alias("ids"))


@query(f""", {_RULES},
 un as (select * from fk anti join kn using (direction, p, q, cand)),
 bc as (select direction, p, q, cand, list(conf order by conf desc) as l, list(rule_id order by conf desc, rule_id) as ids from un group by all),
 rk as (select *, row_number() over (partition by direction, p, q order by l desc, cand) as pos from bc)
 select rk.direction, t.s, t.p, t.o, rk.cand, (rk.pos - 1)::int as pos, array_to_string(rk.ids[1:3], ',') as ids from t join rk on rk.p = t.p and rk.q = case rk.direction when 'tail' then t.s else t.o end where t.p in {_TARGETS} and rk.pos <= 4""")
def explanation_records(spark, d):
    """Explanation records of every triple of five relations, both directions, made with the rule file, written and read back."""
    triples = graph.projected(spark, d)
    loaded = rules.from_lines(rule_file(spark, d))
    found = saved(ruleset.apply_rules(loaded, triples, _asked(triples), _known(triples), topk=4, top_rules=5, shapes=SHAPES), "applied")
    records = formats.explained(graph.project(spark, d, _TARGETS), found.select("direction", "p", "q", "cand", (-F.col("pos")).alias("score")), found, most=3)
    path = f"{tables_dir(spark)}/records-{uuid.uuid4().hex}"
    records.select("value").write.text(path)
    back = formats.explanations(spark.read.text(path))
    return back.select("direction", "s", "p", "o", "cand", F.col("pos").cast("int").alias("pos"), joined("rule_ids").alias("ids"))


@query(f", {_RULES} select direction, p, rule_id, count(*) as n, count(distinct q) as queries from fk group by all")
def rule_apply_file_counts(spark, d):
    """How often each rule of the file fires in each direction, known answers and all."""
    triples = graph.projected(spark, d)
    loaded = rules.from_lines(rule_file(spark, d)).filter("num_true >= 5")
    return ruleset.fired(loaded, triples, _asked(triples)).groupBy("direction", "p", "rule_id").agg(F.count("*").alias("n"), F.count_distinct("q").alias("queries"))


@query(f""", {_RULES} select t.s, t.p, t.o, r.rule_id from t join r on r.p = t.p join pr on pr.rule_id = r.rule_id and pr.x = t.s and pr.y = t.o where t.p in {_TARGETS} and fam <> 8
 union select t.s, t.p, t.o, rule_id from t join r on r.p = t.p and fam = 8 and t.o = 'r:' || cast(k1 as varchar)""")
def explain_targets(spark, d):
    """The rules of the file that predict each triple of five relations."""
    triples = graph.projected(spark, d)
    loaded = rules.from_lines(rule_file(spark, d)).filter("num_true >= 5")
    return explain.explained(loaded, triples, triples.filter(F.col("p").isin(*_TARGETS)))


@query()
def completion_run(spark, d):
    """Five relations fitted on their training samples, their best epochs chosen on valid triples, and their metrics on test triples."""
    from .catalogue import _rule_table, applied, shipped

    relation = F.concat(F.lit("r"), (F.col("q") % 5).cast("string"))
    direction = F.when(F.col("q") % 2 == 0, "head").otherwise("tail")
    of = lambda df: df.withColumns({"p": relation, "direction": direction})
    table = saved(of(applied(spark, d)).select("direction", "p", "q", "cand", "rule_ids"), "applied")
    every = saved(of(shipped(spark, d, "q")), "answers")
    golds = lambda part: every.filter(F.col("part") == part).select("direction", "p", "q", F.col("a").alias("gold"))
    train = samples.labelled(table, every.filter("part > 1").select("direction", "p", "q", "a"))
    known = spark.range(5).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("p")).crossJoin(_rule_table(spark, d).select("rule_id", "conf"))  # five rows
    found = run.completion(train.select("p", "rule_ids", "gold"), known, run.Split(table, golds(1)), run.Split(table, golds(0)), graph.read(spark, d, "supplier").count(), epochs=20, every=10)
    return found.by_direction.select("p", "direction", "n", *[F.round(c, 6).alias(c) for c in run.METRICS])
