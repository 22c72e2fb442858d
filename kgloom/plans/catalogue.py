"""The registered queries of the engine, each beside the SQL that gives the same rows.

``fired`` is the relation that most queries start from: one row for a query (an
order), a candidate (a supplier), a rule and its confidence, taken from the
lines of the order tables by arithmetic that both engines share.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as rule
from ..functions import scores
from ..operators import answers, apply, compare, fit, graph, rules, samples, score
from ..sources import formats
from ..store import saved, tables_dir

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"with {COMMON} {sql}" if "{plain}" not in sql else sql.replace("{plain}", "")
        return f

    return put


_PARTS = [f"select '{sp}' || cast({s} as varchar) as s, '{p}' as p, '{op}' || cast({o} as varchar) as o from {t}" for p, t, sp, s, op, o in graph.PROJECTION]
COMMON = f"""triples as ({' union '.join(_PARTS)}),
 shipped as (select distinct l_orderkey as q, l_suppkey as a, (l_orderkey * 31 + l_suppkey * 17) % 10 as part from lineitem),
 fired as (select distinct l_orderkey as q, l_suppkey as cand, cast(l_partkey % 50 + 1 as int) as rule_id, cast(l_partkey % 50 + 1 as double) / 100 as conf from lineitem),
 applied as (select 'tail' as direction, 'shipped_by' as p, q, cand, list(rule_id order by rule_id) as rule_ids from fired group by q, cand),
 golds as (select q, a as gold from shipped where part = 0),
 known as (select q, a as cand from shipped where part > 0)"""


# The common relations with DataFrames


def line_tasks(spark, d):
    return graph.tasks_of(graph.read(spark, d, "lineitem"))


def shipped(spark, d, *by):
    """The pairs of the lines, each once; dealt by the columns ``by`` if given."""
    rows = graph.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("a"), ((F.col("l_orderkey") * 31 + F.col("l_suppkey") * 17) % 10).alias("part"))
    return (graph.dealt(rows, line_tasks(spark, d), *by) if by else rows).distinct()


def _fired_lines(spark, d):
    n = (F.col("l_partkey") % 50 + 1).cast("int")
    return graph.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("cand"), n.alias("rule_id"), (n.cast("double") / 100).alias("conf"))


def fired(spark, d, *by):
    """The rules that fire, each once for a query and candidate; dealt by the columns ``by`` if given."""
    rows = _fired_lines(spark, d)
    return (graph.dealt(rows, line_tasks(spark, d), *by) if by else rows).distinct()


def applied(spark, d):
    """The rules of each query and candidate; dealt by query."""
    rows = graph.dealt(_fired_lines(spark, d).drop("conf"), line_tasks(spark, d), "q")
    of_cand = Window.partitionBy("q", "cand").orderBy("rule_id")  # half the time of a grouped collect_set, which sorts twice
    held = F.collect_set("rule_id").over(of_cand.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumns({"rule_ids": held, "_n": F.row_number().over(of_cand)}).filter("_n = 1")
    return rows.select(F.lit("tail").alias("direction"), F.lit("shipped_by").alias("p"), "q", "cand", F.sort_array("rule_ids").alias("rule_ids"))


def golds(spark, d):
    return shipped(spark, d).filter("part = 0").select("q", F.col("a").alias("gold"))


def joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def long(c):
    return F.col(c).cast("long").alias(c)


# Graph


@query("select p, count(*) as n, count(distinct s) as subjects, count(distinct o) as objects from triples group by p")
def kg_projection_counts(spark, d):
    rows = graph.projected(spark, d)
    return graph.sizes(graph.by_subject(rows, graph.tasks_of(rows)))


@query("select row_number() over (order by token) - 1 as id, token from (select s as token from triples union select o from triples)")
def kg_entity_dict_sorted(spark, d):
    return graph.sorted_dictionary(graph.projected(spark, d))


_SEEN = " union all ".join(f"select '{sp}' || cast({s} as varchar) as s, '{op}' || cast({o} as varchar) as o, {n} as rel, row_number() over (order by {', '.join(keys)}) as ord from {t}" for n, ((p, t, sp, s, op, o), keys) in enumerate(zip(graph.PROJECTION, graph.ROW_ORDER, strict=True)))


@query(f", seen as ({_SEEN}), f as (select token, min((rel, ord, side)) as first from (select rel, ord, unnest([0, 1]) as side, unnest([s, o]) as token from seen) group by token) select row_number() over (order by first) - 1 as id, token from f")
def kg_entity_dict_first_seen(spark, d):
    """Entities numbered by their first appearance in the lines of all relations, one relation after the other."""
    return graph.first_seen_dictionary(graph.in_file_order(spark, d))


@query(", part_of as (select * from triples where p not in ('supplied_by', 'has_type')), e as (select row_number() over (order by token) - 1 as id, token from (select s as token from part_of union select o from part_of)), r as (select row_number() over (order by p) - 1 as id, p from (select distinct p from part_of)) select a.id as s, r.id as p, b.id as o from triples t join e a on a.token = t.s join r on r.p = t.p join e b on b.token = t.o")
def kg_encode(spark, d):
    """Lenient: all triples by dictionaries that lack two relations and their own tokens."""
    rows = graph.projected(spark, d)
    some, tasks = rows.filter("p not in ('supplied_by', 'has_type')"), graph.tasks_of(rows)
    relations = graph.numbered(some.select("p").distinct(), [F.col("p")], "id").withColumnRenamed("p", "token")
    return graph.encode(graph.by_subject(rows, tasks), graph.sorted_dictionary(some), relations, tasks=tasks)


@query("select 'o:' || cast(q as varchar) as s, 'shipped_by' as p, 's:' || cast(a as varchar) as o from shipped where part = 0 and q in (select q from shipped where part > 1) and a in (select a from shipped where part > 1)")
def kg_split_without_unseen(spark, d):
    t = shipped(spark, d).select(F.concat(F.lit("o:"), F.col("q").cast("string")).alias("s"), F.lit("shipped_by").alias("p"), F.concat(F.lit("s:"), F.col("a").cast("string")).alias("o"), "part")
    return graph.without_unseen(t.filter("part = 0"), t.filter("part > 1"))


@query(", a as (select 'tail' as direction, p, s as q, o as a from triples union select 'head', p, o, s from triples) select direction, p, q, count(*) as n, min(a) as first, max(a) as last from a group by all")
def kg_sp_index(spark, d):
    rows = graph.projected(spark, d)
    return graph.index(graph.by_subject(rows, graph.tasks_of(rows)), F.count("*").alias("n"), F.min("a").alias("first"), F.max("a").alias("last"))


@query("select r.p, count(t.s) as n from (select distinct p from triples) r left join (select * from triples where (length(s) * 7 + length(o)) % 5 = 0 and p not in ('in_region', 'has_brand')) t using (p) group by r.p")
def kg_relation_counts_zero_filled(spark, d):
    """A test split over all relations but two against all relations."""
    t = graph.project(spark, d)
    return graph.relation_counts(t.filter("(length(s) * 7 + length(o)) % 5 = 0 and p not in ('in_region', 'has_brand')"), t.select("p").distinct())


@query(", a as (select 'tail' as direction, s as q from triples union select 'head', o from triples) select direction, count(*) as keys from a group by all")
def kg_eval_keys(spark, d):
    return graph.answers(graph.project(spark, d)).select("direction", "q").distinct().groupBy("direction").agg(F.count("*").alias("keys"))


# The same over all relations


@query(", e as (select row_number() over (order by token) - 1 as id, token from (select s as token from triples union select o from triples)), r as (select row_number() over (order by p) - 1 as id, p from (select distinct p from triples)) select a.id as s, r.id as p, b.id as o from triples t join e a on a.token = t.s join r on r.p = t.p join e b on b.token = t.o")
def kg_encode_all(spark, d):
    rows = graph.projected(spark, d)
    tasks = graph.tasks_of(rows)
    relations = graph.numbered(rows.select("p").distinct(), [F.col("p")], "id").withColumnRenamed("p", "token")
    return graph.encode(graph.by_subject(rows, tasks), graph.sorted_dictionary(rows), relations, strict=True, tasks=tasks)


@query(", a as (select 'tail' as direction, p, s as q, o as a from triples union select 'head', p, o, s from triples) select direction, p, q, count(*) as n from a group by all")
def kg_sp_index_all(spark, d):
    rows = graph.projected(spark, d)
    return graph.index(graph.by_subject(rows, graph.tasks_of(rows)), F.count("*").alias("n"))


@query(", a as (select 'tail' as direction, p, s as q from triples union select 'head', p, o from triples) select direction, p, count(*) as keys from a group by all")
def kg_eval_keys_all(spark, d):
    return graph.answers(graph.project(spark, d)).select("direction", "p", "q").distinct().groupBy("direction", "p").agg(F.count("*").alias("keys"))


@query("select r.p, count(t.q) as n from (select distinct p from triples) r left join (select 'shipped_by' as p, q from golds) t using (p) group by r.p")
def kg_relation_counts_of_split(spark, d):
    """The test split of shipped_by against all relations."""
    return graph.relation_counts(golds(spark, d).select(F.lit("shipped_by").alias("p")), graph.project(spark, d).select("p").distinct())


# Rules

_RULE = """case p_partkey % 6 when 0 then 'r' || cast(p_partkey % 7 as {S}) || '(X,Y) <= r' || cast(p_partkey % 5 as {S}) || '(Y,X)'
 when 1 then 'r' || cast(p_partkey % 7 as {S}) || '(X,Y) <= s(X,A), t(A,Y)' when 2 then 'u(X,c' || cast(p_partkey % 9 as {S}) || ') <= s(X,d5)'
 when 3 then 'u(X,c1) <= s(X,A)' when 4 then 'w(c7,Y) <= s(c7,Y)' else 'no arrow(' end"""
_LINES = "select cast(p_partkey + 1 as bigint) as rule_id, case when p_partkey % 13 = 0 then 'bad' when p_partkey % 5 = 0 then cast(p_size as {S}) || '.7' else cast(p_size as {S}) end as preds, cast(p_size / 2 as bigint) as num_true, " + _RULE + " as rule from part"
PARSED = _LINES.format(S="varchar").replace("cast(p_size / 2 as bigint)", "p_size // 2")


def rule_lines(spark, d):
    graph.read(spark, d, "part").createOrReplaceTempView("_rule_part")
    return spark.sql(_LINES.format(S="string").replace("from part", "from _rule_part").replace("cast(p_size / 2 as bigint)", "cast(floor(p_size / 2) as bigint)"))


@query("{plain}select rule_id, case when position('(' in split_part(rule, ' <= ', 1)) > 0 then split_part(split_part(rule, ' <= ', 1), '(', 1) else '' end as head_rel from (" + PARSED + ")")
def rule_parse_head(spark, d):
    return rule_lines(spark, d).select("rule_id", rule.head_relation(F.col("rule")).alias("head_rel"))


@query("{plain}select rule_id, pos, regexp_extract(a, '^(.+)\\((.*),(.*)\\)$', 1) as rel, regexp_extract(a, '^(.+)\\((.*),(.*)\\)$', 2) as x, regexp_extract(a, '^(.+)\\((.*),(.*)\\)$', 3) as y from (select rule_id, unnest(str_split(split_part(rule, ' <= ', 2), ', ')) as a, generate_subscripts(str_split(split_part(rule, ' <= ', 2), ', '), 1) - 1 as pos from (" + PARSED + ") where rule like '% <= %')")
def rule_parse_atoms(spark, d):
    return rule_lines(spark, d).select("rule_id", F.posexplode(rule.body(F.col("rule"))).alias("pos", "a")).select("rule_id", long("pos"), "a.rel", "a.x", "a.y")


@query("{plain}select rule_id, n as num_preds, round(case when n > 0 then num_true / (n + 5) else 0 end, 9) as conf from (select *, coalesce(cast(trunc(try_cast(preds as double)) as bigint), 0) as n from (" + PARSED + "))")
def rule_confidence_laplace(spark, d):
    n = rule.count_of(F.col("preds"))
    return rule_lines(spark, d).select("rule_id", n.alias("num_preds"), F.round(rule.confidence(n, F.col("num_true")), 9).alias("conf"))


def _atom(text: str, n: int) -> str:
    return f"regexp_extract({text}, '^(.+)\\((.*),(.*)\\)$', {n})"


#: The parsed rules with the terms of their heads and of the first and last atoms of their bodies.
TERMS = f"""select *, {_atom("split_part(rule, ' <= ', 1)", 2)} as hx, {_atom("split_part(rule, ' <= ', 1)", 3)} as hy, len(atoms) as n,
 {_atom("atoms[1]", 2)} as fx, {_atom("atoms[1]", 3)} as fy, {_atom("atoms[-1]", 2)} as lx, {_atom("atoms[-1]", 3)} as ly
 from (select *, case when rule like '% <= %' then str_split(split_part(rule, ' <= ', 2), ', ') end as atoms from ({{rules}}))"""
_CONST = "not regexp_matches({0}, '^[A-Z]$')".format
TRIVIAL = f"coalesce(n = 1 and ((fx = 'X' and fy = 'Y') or (fx = 'Y' and fy = 'X') or ({_CONST('hx')} and hx in (fx, fy)) or ({_CONST('hy')} and hy in (fx, fy))), false)"
_FREE = f"(case when lx = (case when {_CONST('hy')} then hx else hy end) then ly else lx end)"
SHAPE = f"""case when atoms is null then null when n = 1 and atoms[1] = '' then 'zero' when hx = hy then case when {_CONST(_FREE)} then 'u_xxc' else 'u_xxd' end
 when not {_CONST('hx')} and not {_CONST('hy')} then 'cyclic' when {_CONST(_FREE)} then 'u_c' else 'u_d' end"""
_TERMS_OF_PART = TERMS.format(rules=PARSED)
_HEAD = "case when position('(' in split_part(rule, ' <= ', 1)) > 0 then split_part(split_part(rule, ' <= ', 1), '(', 1) else '' end"


@query("{plain}select rule_id, rule from (" + _TERMS_OF_PART + f") where not {TRIVIAL}")
def rule_trivial_filter(spark, d):
    return rule_lines(spark, d).filter(~rule.is_trivial(F.col("rule"))).select("rule_id", "rule")


@query("{plain}select rule_id as old_id, row_number() over (order by " + _HEAD + ", rule_id) - 1 as new_id from (" + _TERMS_OF_PART + f") where not {TRIVIAL}")
def rule_renumber(spark, d):
    return rules.renumbered(rule_lines(spark, d).withColumn("head_rel", rule.head_relation(F.col("rule"))))


@query("{plain}select rule_id, shape from (select *, " + SHAPE + " as shape from (" + _TERMS_OF_PART + ")) where shape in ('cyclic', 'u_c') and num_true >= case shape when 'cyclic' then 3 else 6 end and (shape <> 'cyclic' or n <= 1)")
def rule_type_filter(spark, d):
    """Cyclic rules of one atom and rules with a constant, of enough support: what a rule loader is told to take."""
    lines = rule_lines(spark, d)
    return lines.filter(rule.is_active(F.col("rule"), F.col("num_true"), ("cyclic", "u_c"), 3, 6, 1)).select("rule_id", rule.shape(F.col("rule")).alias("shape"))


@query("{plain}select p_brand as brand, 2 * row_number() over (partition by p_brand order by p_partkey) - 1 as rule_id, p_size as num_true, 'h' || cast(p_partkey % 3 as varchar) as head_rel from part")
def rule_line_ids(spark, d):
    """A rule file for each brand, with blank lines between the rules, written and read back."""
    part = graph.read(spark, d, "part")
    text = F.concat_ws("\t", F.lit("10"), F.col("p_size").cast("string"), F.lit("0.1"), F.concat(F.lit("h"), (F.col("p_partkey") % 3).cast("string"), F.lit("(X,Y) <= b(X,Y)")))
    path = f"{tables_dir(spark)}/rules-{uuid.uuid4().hex}"
    part.repartition("p_brand").sortWithinPartitions("p_brand", "p_partkey").select(F.col("p_brand").alias("brand"), F.concat(text, F.lit("\n")).alias("value")).write.partitionBy("brand").text(path)
    return rules.from_lines(formats.rule_lines(spark, path).drop("file")).select("brand", long("rule_id"), F.col("num_true").cast("int").alias("num_true"), "head_rel")


# Rule application


def _rules(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@query("select 1 as rule_id, s as x, o as y from triples where p = 'cust_nation' union select 2, o, s from triples where p = 'supp_nation'")
def rule_apply_cyclic1(spark, d):
    return apply.cyclic(_rules(spark, [(1, "cust_nation", False), (2, "supp_nation", True)], "rule_id int, rel1 string, inv1 boolean"), graph.projected(spark, d), 1)


@query("select distinct 1 as rule_id, a.s as x, b.o as y from triples a join triples b on a.o = b.s where a.p = 'cust_nation' and b.p = 'in_region' union select distinct 2, a.s, b.s from triples a join triples b on a.o = b.o where a.p = 'supp_nation' and b.p = 'supp_nation'")
def rule_apply_cyclic2(spark, d):
    rows = [(1, "cust_nation", False, "in_region", False), (2, "supp_nation", False, "supp_nation", True)]
    return apply.cyclic(_rules(spark, rows, "rule_id int, rel1 string, inv1 boolean, rel2 string, inv2 boolean"), graph.projected(spark, d), 2)


@query("select distinct 1 as rule_id, a.s as x, c.o as y from triples a join triples b on a.o = b.s join triples c on b.o = c.s where a.p = 'ordered_by' and b.p = 'cust_nation' and c.p = 'in_region'")
def rule_apply_cyclic3(spark, d):
    rows = [(1, "ordered_by", False, "cust_nation", False, "in_region", False)]
    return apply.cyclic(_rules(spark, rows, "rule_id int, rel1 string, inv1 boolean, rel2 string, inv2 boolean, rel3 string, inv3 boolean"), graph.projected(spark, d), 3)


@query("select 1 as rule_id, s as x, 'n:3' as y from triples where p = 'in_segment' and o = 'm:BUILDING' union select 2, s, 'm:MACHINERY' from triples where p = 'cust_nation' and o = 'n:7'")
def rule_apply_uc(spark, d):
    rows = [(1, "in_segment", False, "m:BUILDING", "n:3"), (2, "cust_nation", False, "n:7", "m:MACHINERY")]
    return apply.with_constant(_rules(spark, rows, "rule_id int, rel string, inv boolean, const string, answer string"), graph.projected(spark, d))


@query("select distinct 1 as rule_id, s as x, 'm:BUILDING' as y from triples where p = 'cust_nation' union select distinct 2, o, 'r:1' from triples where p = 'supp_nation'")
def rule_apply_ud(spark, d):
    return apply.dangling(_rules(spark, [(1, "cust_nation", False, "m:BUILDING"), (2, "supp_nation", True, "r:1")], "rule_id int, rel string, inv boolean, answer string"), graph.projected(spark, d))


@query("select distinct 1 as rule_id, s as x, 'r:0' as y from triples where p = 'in_region'")
def rule_apply_zero(spark, d):
    t = graph.projected(spark, d)
    return apply.zero(_rules(spark, [(1, "in_region", "r:0")], "rule_id int, head_rel string, answer string"), t.select("p", F.col("s").alias("x")).distinct())


@query("select distinct 1 as rule_id, s as x, s as y from triples where p = 'in_region' and o = 'r:2'")
def rule_apply_reflexive(spark, d):
    return apply.reflexive(_rules(spark, [(1, "in_region", False, "r:2")], "rule_id int, rel string, inv boolean, const string"), graph.projected(spark, d))


_SPLIT = """tr as (select q, a from shipped where part > 1), co as (select distinct l_orderkey as q, l_partkey as v from lineitem),
 sb as (select distinct l_partkey as v, l_suppkey as a from lineitem where (l_orderkey * 31 + l_suppkey * 17) % 10 > 1),
 np as (select v, count(*) as num_preds from co group by v),
 uc as (select v, a, count(*) as num_true from tr join co using (q) group by v, a having count(*) >= 2),
 ucr as (select v, a, num_preds, num_true, num_true / (num_preds + 5) as conf from uc join np using (v)),
 cy as (select distinct q, a from co join sb using (v)),
 cyc as (select count(*) as num_preds, count(t.q) as num_true from cy left join tr t using (q, a))"""


def _parts(spark, d):
    lines = graph.read(spark, d, "lineitem")
    train = shipped(spark, d, "q").filter("part > 1").select("q", "a")
    contains = graph.dealt(lines.select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("v")), line_tasks(spark, d), "q").distinct()
    supplied = lines.filter((F.col("l_orderkey") * 31 + F.col("l_suppkey") * 17) % 10 > 1).select(F.col("l_partkey").alias("v"), F.col("l_suppkey").alias("a"))
    return train, contains, supplied


def mined(train, contains, tasks=None):
    """Rules shipped_by(X,a) <= contains(X,v) with at least two true predictions."""
    true = graph.dealt(train.join(contains, "q"), tasks, "v", "a").groupBy("v", "a").agg(F.count("*").alias("num_true")).filter("num_true >= 2")
    preds = contains.groupBy("v").agg(F.count("*").alias("num_preds"))
    return true.join(preds, "v").select("v", "a", "num_preds", "num_true", rule.confidence(F.col("num_preds"), F.col("num_true")).alias("conf"))


@query(f", {_SPLIT} select v, a, num_preds, num_true, round(conf, 9) as conf from ucr")
def rule_mine_uc(spark, d):
    train, contains, _ = _parts(spark, d)
    return mined(train, contains, line_tasks(spark, d)).withColumn("conf", F.round("conf", 9))


@query(f", {_SPLIT} select 1 as rule_id, num_preds, num_true from cyc")
def rule_support_counts(spark, d):
    train, contains, supplied = _parts(spark, d)
    contains = saved(contains, "contains")
    found = answers.followed(contains, _suppliers(supplied, contains), "q", "v", supplied, "a")
    return answers.followed_support(found, train, "q", "a").select(F.lit(1).alias("rule_id"), "num_preds", "num_true")


def _suppliers(supplied, contains):
    """The suppliers of each part, written once."""
    tasks = max(int(contains.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-contains.count() // answers.LISTS_A_TASK))
    return saved(answers.lists_of(supplied, "v", "a", tasks), "suppliers")


_SLICE = f"""{_SPLIT},
 fl as (select q, ucr.a as cand, conf from (select distinct gold_q as q from (select q as gold_q from golds)) g join co using (q) join ucr using (v)
  union all select q, a, (select num_true / (num_preds + 5) from cyc) from cy where q in (select q from golds)),
 sc as (select q, cand, round(1 - exp(sum(ln(1 - conf))), 9) as s from fl anti join known using (q, cand) group by q, cand),
 c as (select sc.* from sc left join golds g on sc.q = g.q and sc.cand = g.gold where g.gold is null and s > 0),
 rk as (select g.q, g.gold, x.s, count(c.cand) as n, count(case when c.s > x.s then 1 end) as more, count(case when c.s = x.s then 1 end) as same
  from golds g left join sc x on g.q = x.q and g.gold = x.cand left join c on c.q = g.q group by all),
 rr as (select *, case when q in (select q from sc) then case when s > 0 then more + (same + 2) / 2 else n + ((select count(*) from supplier) - n + 1) / 2 end end as rank from rk)"""


@query(f", {_SLICE} select count(*) as golds, round(sum(1 / rank) / count(*), 9) as mrr, round(count(case when rank = 1 then 1 end) / count(*), 9) as h1, round(count(case when rank <= 10 then 1 end) / count(*), 9) as h10 from rr")
def shipped_by_completion(spark, d):
    """Mined constant rules and one cyclic rule, applied to the held-out orders, scored by noisy-or and ranked."""
    every = saved(shipped(spark, d), "shipped")
    train, gold = every.filter("part > 1").select("q", "a"), every.filter("part = 0").select("q", F.col("a").alias("gold"))
    known = every.filter("part > 0").select("q", "a")
    _, contains, supplied = _parts(spark, d)
    contains = saved(contains, "contains")
    by_part = _suppliers(supplied, contains)
    counts = answers.followed_support(answers.followed(contains, by_part, "q", "v", supplied, "a"), train, "q", "a").select(rule.confidence(F.col("num_preds"), F.col("num_true")).alias("conf"))
    counts = saved(counts, "counts")
    of_asked = saved(contains.join(gold.select("q").distinct(), "q", "left_semi"), "asked")
    path = answers.followed(of_asked, by_part, "q", "v", supplied, "a")
    by_path = answers.followed_pairs(path).select(F.col("node").alias("q"), F.col("answer").alias("a")).crossJoin(F.broadcast(counts))  # counts is one row
    by_constant = of_asked.join(mined(train, contains, line_tasks(spark, d)), "v").select("q", "a", "conf")
    none = F.lit(None).cast("double")
    parts = ((by_path, 0), (graph.dealt(by_constant, path.tasks, "q"), 0), (graph.dealt(known.join(gold.select("q").distinct(), "q", "left_semi"), path.tasks, "q").withColumn("conf", none), 1), (graph.dealt(gold, path.tasks, "q").select("q", F.col("gold").alias("a"), none.alias("conf")), 2))
    rows = reduce(DataFrame.unionByName, [part.select("q", F.col("a").cast("long").alias("cand"), "conf", F.lit(what).alias("what")) for part, what in parts])
    # all meet by query: what fired, what is known and what is asked for
    of = lambda what: F.col("what") == what
    rows = rows.groupBy("q", "cand").agg(F.sum(F.log(1 - F.col("conf"))).alias("_sum"), (F.max(of(0)) & ~F.max(of(1))).alias("is_cand"), F.sum(F.when(of(2), 1).otherwise(0)).alias("golds"))
    rows = rows.withColumns({"s": F.when(F.col("is_cand"), F.round(1 - F.exp("_sum"), score.DIGITS)), "counts": F.col("is_cand") & (F.col("golds") == 0)}).filter("is_cand or golds > 0")
    entities = graph.read(spark, d, "supplier").count()
    return score.metrics(score.ranks_of_marked(rows, ["q"], entities), [], "golds").select(F.col("n").alias("golds"), *[F.round(c, 9).alias(c) for c in ("mrr", "h1", "h10")])


flagship = shipped_by_completion


# Rankings

_TOP = "select q, cand, l, row_number() over (partition by q order by l desc, cand) as pos from (select q, cand, list(conf order by conf desc) as l from fired group by q, cand)"


@query(f"select q, cand, pos, round(l[1], 9) as best, len(l) as n from ({_TOP}) where pos <= 3")
def rank_maxplus_topk(spark, d):
    return apply.maxplus_topk(fired(spark, d), ["q"], 3).select("q", "cand", long("pos"), F.round(F.col("confs")[0], 9).alias("best"), F.size("confs").cast("long").alias("n"))


@query(f", tk as (select * from ({_TOP}) where pos <= 2) select q, cand, rule_id from fired semi join tk using (q, cand)")
def topk_semi_join(spark, d):
    f = fired(spark, d)
    return apply.in_topk(f, apply.maxplus_topk(f, ["q"], 2), ["q"]).select("q", "cand", "rule_id")


@query("select q, cand, string_agg(cast(rule_id as varchar), ',' order by rule_id desc) as ids from (select *, row_number() over (partition by q, cand order by conf desc, rule_id) as rn from fired) where rn <= 1 group by q, cand")
def rules_per_candidate_cap(spark, d):
    f = fired(spark, d)
    return apply.capped(apply.maxplus_topk(f, ["q"], 10**9), 1).select("q", "cand", joined("rule_ids").alias("ids"))


@query("select q, cand, count(*) as n from fired anti join known using (q, cand) group by q, cand")
def filter_known_triples(spark, d):
    return apply.unknown_only(fired(spark, d), shipped(spark, d).filter("part > 0"), ["q"]).groupBy("q", "cand").agg(F.count("*").alias("n"))


@query(", t as (select q, min(cand) as target from fired group by q) select q, cand from (select distinct q, cand from fired) join t using (q) where cand = target or (q, cand) not in (select (q, cand) from known)")
def target_exempt_filter(spark, d):
    f = fired(spark, d).select("q", "cand").distinct()
    f = f.join(f.groupBy("q").agg(F.min("cand").alias("target")), "q")
    return apply.unknown_only(f, shipped(spark, d).filter("part > 0"), ["q"], "target").select("q", "cand")


@query("{plain}select direction, 'r' || cast(c_nationkey as varchar) as p, 'q' || cast(c_custkey as varchar) as q, cand, ids from (select *, unnest(['head', 'tail']) as direction, unnest(['a', 'b']) as cand, unnest(['1,2', '']) as ids from customer)")
def applied_json_flatten(spark, d):
    one = lambda side, cand, ids: F.concat(F.lit(f'"{side}":{{"r'), F.col("c_nationkey").cast("string"), F.lit('":{"q'), F.col("c_custkey").cast("string"), F.lit(f'":{{"{cand}":{ids}}}}}}}'))
    texts = graph.read(spark, d, "customer").select(F.concat(F.lit("{"), one("head", "a", "[1,2]"), F.lit(","), one("tail", "b", "[]"), F.lit("}")).alias("value"))
    return formats.flattened(texts).select("direction", "p", "q", "cand", joined("rule_ids").alias("ids"))


@query("{plain}select direction, 's' || cast(c_custkey as varchar) as s, cand, ids, pos from (select *, unnest(['head', 'head', 'tail']) as direction, unnest(['a', 'b', 'c']) as cand, unnest(['1,2', '3', '']) as ids, unnest([0, 1, 0]) as pos from customer)")
def explanation_stream_parse(spark, d):
    texts = graph.read(spark, d, "customer").select(F.concat(F.lit("{'s"), F.col("c_custkey").cast("string"), F.lit(" p o': {'heads': {'candidates': ['a', 'b'], 'rules': [[1, 2], [3]]}, 'tails': {'candidates': ['c'], 'rules': [[]]}}},")).alias("value"))
    return formats.explanations(texts).select("direction", "s", "cand", joined("rule_ids").alias("ids"), F.col("pos").cast("int").alias("pos"))


@query("{plain}select c_custkey as q, case when c_custkey % 3 = 0 then cast(c_custkey as varchar) else c_mktsegment end as cand from customer")
def reflexive_rewrite(spark, d):
    t = graph.read(spark, d, "customer").select(F.col("c_custkey").alias("q"), F.when(F.col("c_custkey") % 3 == 0, "me_myself_i").otherwise(F.col("c_mktsegment")).alias("cand"))
    return apply.reflexive_named(t.withColumn("name", F.col("q").cast("string")), "name").select("q", "cand")


# Samples


@query("select q, cand, array_to_string(rule_ids, ',') as ids, case when part > 1 then 1 else 0 end as gold from applied join shipped on shipped.q = applied.q and a = cand where applied.q in (select q from shipped where part > 1)".replace("select q,", "select applied.q,"))
def train_samples(spark, d):
    train = shipped(spark, d, "q").filter("part > 1").select(F.lit("tail").alias("direction"), F.lit("shipped_by").alias("p"), "q", "a")
    return samples.labelled(applied(spark, d), train).select("q", "cand", joined("rule_ids").alias("ids"), "gold")


def _train(spark, d):
    train = shipped(spark, d, "q").filter("part > 1").select(F.lit("tail").alias("direction"), F.lit("shipped_by").alias("p"), "q", "a")
    return samples.labelled(applied(spark, d), train)


def _rule_table(spark, d):
    return _fired_lines(spark, d).select(F.lit("shipped_by").alias("p"), "rule_id", "conf").distinct()


@query("select p, rule_id, count(*) as train_hit_count from (select distinct 'shipped_by' as p, f.q, f.cand, rule_id from fired f join shipped s on s.q = f.q and s.a = f.cand where part > 1) group by all")
def train_hit_counts(spark, d):
    return samples.hit_counts(_train(spark, d), _rule_table(spark, d))


_PAIRS = "select distinct 'shipped_by' as p, least(x, y) as a, greatest(x, y) as b from (select cast(p_partkey % 50 + 1 as int) as x, cast(p_partkey * 7 % 50 + 1 as int) as y from part)"


def _pairs(spark, d):
    x, y = (F.col("p_partkey") % 50 + 1).cast("int"), (F.col("p_partkey") * 7 % 50 + 1).cast("int")
    return graph.read(spark, d, "part").select(F.lit("shipped_by").alias("p"), F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


@query(f", pr as ({_PAIRS}), h as (select f.q, f.cand, rule_id from fired f join shipped s on s.q = f.q and s.a = f.cand where part > 1) select p, pr.a, pr.b, count(*) as train_hit_count from pr join h x on x.rule_id = pr.a join h y on y.rule_id = pr.b and y.q = x.q and y.cand = x.cand group by all")
def train_pair_hit_counts(spark, d):
    return samples.pair_hit_counts(_train(spark, d), _pairs(spark, d))


_LIFT = "select p_partkey as line, p_size as support, cast(p_partkey % 90 as double) / 100 as lift, cast(p_partkey % 50 + 1 as int) as rule1, cast(p_partkey * 7 % 50 + 1 as int) as rule2 from part"


def _lift(spark, d):
    return graph.read(spark, d, "part").select(F.col("p_partkey").alias("line"), F.col("p_size").alias("support"), ((F.col("p_partkey") % 90).cast("double") / 100).alias("lift"), (F.col("p_partkey") % 50 + 1).cast("int").alias("rule1"), (F.col("p_partkey") * 7 % 50 + 1).cast("int").alias("rule2"))


_SYN = f", sy as (select a, b, lift from (select least(rule1, rule2) as a, greatest(rule1, rule2) as b, lift, row_number() over (partition by least(rule1, rule2), greatest(rule1, rule2) order by line) as rn from ({_LIFT}) where support >= 5 and lift >= 0.01 and rule1 % 2 = rule2 % 2) where rn = 1)"


def _two_relations(spark):
    return spark.range(1, 51).select(F.col("id").cast("int").alias("rule_id"), F.concat(F.lit("p"), (F.col("id") % 2).cast("string")).alias("p"))


@query(_SYN + " select 'p' || cast(a % 2 as varchar) as p, a, b, lift from sy")
def synergy_filter_dedup(spark, d):
    return samples.synergy_pairs(_lift(spark, d), _two_relations(spark))


@query(_SYN + " select x.q, x.cand, sy.a, sy.b from sy join fired x on x.rule_id = sy.a join fired y on y.rule_id = sy.b and y.q = x.q and y.cand = x.cand")
def synergy_pair_match(spark, d):
    syn = samples.synergy_pairs(_lift(spark, d), _two_relations(spark)).withColumn("p", F.lit("shipped_by"))
    return samples.pairs_in(applied(spark, d), syn).select("q", "cand", "a", "b")


# Scores


@query("select q, cand, round(max(conf), 9) as score from fired group by q, cand")
def score_max_conf(spark, d):
    return fired(spark, d).groupBy("q", "cand").agg(F.round(scores.max_conf(), 9).alias("score"))


@query("select q, cand, round(sum(conf) + 0.1, 9) as score from fired group by q, cand")
def score_linear_initial(spark, d):
    return fired(spark, d).withColumn("weight", F.col("conf")).groupBy("q", "cand").agg(F.round(scores.linear(0.1), 9).alias("score"))


@query("select q, cand, round(greatest(1e-7, least(1 - 1e-7, 1 - exp(sum(ln(1 - conf))))), 9) as score from fired group by q, cand")
def score_noisy_or(spark, d):
    return fired(spark, d).withColumn("weight", scores.surprisal(F.col("conf"))).groupBy("q", "cand").agg(F.round(scores.noisy_or(), 9).alias("score"))


@query(_SYN + ", g as (select x.q, x.cand, sum(lift) as extra from sy join fired x on x.rule_id = sy.a join fired y on y.rule_id = sy.b and y.q = x.q and y.cand = x.cand group by all) select q, cand, round(greatest(1e-7, least(1 - 1e-7, 1 - exp(sum(ln(1 - conf)) - coalesce(any_value(extra), 0)))), 9) as score from fired left join g using (q, cand) group by q, cand")
def score_noisy_or_synergy(spark, d):
    syn = samples.synergy_pairs(_lift(spark, d), _two_relations(spark)).withColumn("p", F.lit("shipped_by"))
    extra = samples.pairs_in(applied(spark, d), syn).groupBy("q", "cand").agg(F.sum("lift").alias("extra"))
    f = fired(spark, d).withColumn("weight", scores.surprisal(F.col("conf"))).join(extra, ["q", "cand"], "left")
    return f.groupBy("q", "cand").agg(F.round(scores.noisy_or(extra=F.coalesce(F.first("extra"), F.lit(0.0))), 9).alias("score"))


@query("select q, cand, round(ln(1 + exp(sum(conf))), 9) as score from fired group by q, cand")
def score_softplus(spark, d):
    return fired(spark, d).groupBy("q", "cand").agg(F.round(scores.softplus(F.sum("conf")), 9).alias("score"))


@query(", x as (select round(1 - exp(sum(ln(1 - conf))), 9) as p, case when (q, cand) in (select (q, gold) from golds) then 1 else 0 end as gold from fired group by q, cand), l as (select gold, -(gold * ln(p) * 5 + (1 - gold) * ln(1 - p)) as l from x) select round(avg(l), 6) as mean_loss, round(sum(l), 3) as sum_loss, round((avg(case when gold = 1 then l end) + avg(case when gold = 0 then l end)) / 2, 6) as class_mean_loss from l")
def bce_losses(spark, d):
    pred = fired(spark, d).groupBy("q", "cand").agg(F.round(1 - F.exp(F.sum(F.log(1 - F.col("conf")))), 9).alias("pred"))
    gold = golds(spark, d).withColumnRenamed("gold", "cand").withColumn("gold", F.lit(1))
    return score.losses(pred.join(gold, ["q", "cand"], "left").withColumn("gold", F.coalesce("gold", F.lit(0)))).select(F.round("mean_loss", 6).alias("mean_loss"), F.round("sum_loss", 3).alias("sum_loss"), F.round("class_mean_loss", 6).alias("class_mean_loss"))


def _rank_sql(value: str) -> str:
    return f""", sc as (select q, cand, round({value}, 9) as s from fired group by q, cand),
 c as (select sc.* from sc anti join known using (q, cand) where s > 0 and (q, cand) not in (select (q, gold) from golds)),
 rk as (select g.q, g.gold, x.s, count(c.cand) as n, count(case when c.s > x.s then 1 end) as more, count(case when c.s = x.s then 1 end) as same
  from golds g left join sc x on g.q = x.q and g.gold = x.cand left join c on c.q = g.q group by all),
 rr as (select q, gold, case when q in (select q from sc) then case when s > 0 then more + (same + 2) / 2 else n + ((select count(*) from supplier) - n + 1) / 2 end end as rank from rk)"""


def _ranked(spark, d, value):
    scored = fired(spark, d).groupBy("q", "cand").agg(value.alias("score"))
    return score.ranks(scored, golds(spark, d), graph.read(spark, d, "supplier").count(), ["q"], shipped(spark, d).filter("part > 0").select("q", F.col("a").alias("cand")))


@query(_rank_sql("max(conf)") + " select q, gold, rank from rr")
def rank_filtered_tie_mean(spark, d):
    return _ranked(spark, d, F.max("conf")).select("q", "gold", "rank")


@query(_rank_sql("max(conf) * (1 - exp(sum(ln(1 - conf))))") + " select q, gold, rank from rr")
def rank_raw_vs_conf(spark, d):
    return _ranked(spark, d, F.max("conf") * (1 - F.exp(F.sum(F.log(1 - F.col("conf")))))).select("q", "gold", "rank")


@query(_rank_sql("max(conf)") + " select q % 5 as p, count(*) as n, round(sum(1 / rank) / count(*), 9) as mrr, round(count(case when rank = 1 then 1 end) / count(*), 9) as h1, round(count(case when rank <= 10 then 1 end) / count(*), 9) as h10 from rr group by all")
def metrics_by_relation(spark, d):
    m = score.metrics(_ranked(spark, d, F.max("conf")).withColumn("p", F.col("q") % 5), ["p"])
    return m.select("p", "n", *[F.round(c, 9).alias(c) for c in ("mrr", "h1", "h10")])


@query(_rank_sql("max(conf)") + ", m as (select q % 5 as p, case when q % 2 = 0 then 'head' else 'tail' end as direction, sum(1 / rank) / count(*) as mrr from rr group by all) select r.p, round(coalesce(sum(mrr) / 2, 0), 9) as mrr from (select unnest(range(7)) as p) r left join m using (p) group by r.p")
def metrics_head_tail_mean(spark, d):
    r = _ranked(spark, d, F.max("conf")).withColumns({"p": F.col("q") % 5, "direction": F.when(F.col("q") % 2 == 0, "head").otherwise("tail")})
    return score.head_tail_mean(score.metrics(r, ["p", "direction"]), spark.range(7).withColumnRenamed("id", "p")).withColumn("mrr", F.round("mrr", 9))


@query(_rank_sql("max(conf)") + ", m as (select q % 5 as p, sum(1 / rank) / count(*) as mrr, count(*) as n from rr group by all) select round(sum(mrr * n) / sum(n), 9) as mrr from m")
def metrics_weighted(spark, d):
    m = score.metrics(_ranked(spark, d, F.max("conf")).withColumn("p", F.col("q") % 5), ["p"])
    return score.weighted(m.select("p", "mrr"), m.select("p", "n"), ["mrr"]).withColumn("mrr", F.round("mrr", 9))


@query()
def fit_linear_relation(spark, d):
    return fit.fit(_train(spark, d), _rule_table(spark, d), "linear")


@query()
def fit_surprisal_relation(spark, d):
    return fit.fit(_train(spark, d), _rule_table(spark, d), "surprisal")


# Comparison and selection

_SIDES = """, ra as (select q, cand, list(rule_id order by rule_id) as r from fired where q % 7 <> 0 group by q, cand),
 rb as (select q, cand, list(rule_id order by rule_id) as r from fired where q % 5 <> 0 and rule_id % 4 <> 0 group by q, cand)"""


def _sides(spark, d):
    f = fired(spark, d, "q", "cand")
    make = lambda x: x.groupBy("q", "cand").agg(F.sort_array(F.collect_list("rule_id")).alias("rule_ids")).select(F.lit("tail").alias("direction"), F.lit("shipped_by").alias("p"), "q", "cand", "rule_ids")
    return make(f.filter("q % 7 <> 0")), make(f.filter("q % 5 <> 0 and rule_id % 4 <> 0"))


@query(_SIDES + " select coalesce(ra.q, rb.q) as q, coalesce(ra.cand, rb.cand) as cand, case when rb.q is null then 'missing' when ra.q is null then 'extra' when ra.r = rb.r then 'same' else 'mismatch' end as status from ra full outer join rb on ra.q = rb.q and ra.cand = rb.cand")
def applied_diff_full_outer(spark, d):
    return compare.differences(*_sides(spark, d)).select("q", "cand", "status")


@query(_SIDES + " select ra.q, ra.cand, array_to_string(ra.r, ',') as ids from ra semi join rb using (q, cand)")
def applied_common_keys(spark, d):
    return compare.common(*_sides(spark, d)).select("q", "cand", joined("rule_ids").alias("ids"))


@query(", la as (select l_orderkey as q, l_suppkey % 7 as cand, l_linenumber % 3 as x, count(*) as n from lineitem group by all), lb as (select l_orderkey as q, l_suppkey % 7 as cand, l_linenumber % 3 as x, count(*) as n from lineitem where l_partkey % 3 <> 0 group by all), w as (select la.q, la.cand, la.x, la.n - coalesce(lb.n, 0) as n from la left join lb using (q, cand, x) where (la.q, la.cand) in (select (q, cand) from lb)) select q, cand, string_agg(repeat(cast(x as varchar) || ',', n), '' order by x) as only_a from w where n > 0 group by all")
def rule_list_multiset_diff(spark, d):
    """Lists with repetitions, some of which the other side lacks."""
    lines = graph.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), (F.col("l_suppkey") % 7).alias("cand"), (F.col("l_linenumber") % 3).cast("int").alias("rule_id"), "l_partkey")
    make = lambda x: x.groupBy("q", "cand").agg(F.sort_array(F.collect_list("rule_id")).alias("rule_ids")).select(F.lit("tail").alias("direction"), F.lit("shipped_by").alias("p"), "q", "cand", "rule_ids")
    found = compare.differences(make(lines), make(lines.filter("l_partkey % 3 <> 0"))).filter("status = 'mismatch'")
    return found.filter(F.size("only_a") > 0).select("q", "cand", F.concat(joined("only_a"), F.lit(",")).alias("only_a"))


@query(_SIDES + " select q, cand, string_agg(cast(x as varchar), ',' order by x) as only_a from (select q, cand, unnest(r) as x from ra semi join rb using (q, cand)) l anti join (select q, cand, unnest(r) as x from rb) r using (q, cand, x) group by q, cand")
def rule_list_set_diff(spark, d):
    return compare.differences(*_sides(spark, d)).filter("status = 'mismatch'").select("q", "cand", joined("only_a").alias("only_a")).filter("only_a <> ''")


@query("select direction, p, q, count(*) as n, cast(grouping_id(direction, p, q) as int) as level from applied group by rollup (direction, p, q) having direction is not null")
def entry_counts_grouping_sets(spark, d):
    return compare.entry_counts(applied(spark, d))


@query(_SIDES + " select q, 'a' as side from (select distinct q from ra) anti join rb using (q) union all select q, 'b' from (select distinct q from rb) anti join ra using (q)")
def query_key_diff(spark, d):
    return compare.query_key_differences(*_sides(spark, d)).select("q", "side")


_CHOICES = "select c_nationkey % 20 as p, case when c_custkey % 2 = 0 then 'head' else 'tail' end as direction, 'f' || cast(c_custkey % 4 as varchar) as file, c_custkey % 4 as ord, round(avg(c_acctbal), 2) as mrr from customer group by all"


def _choices(spark, d):
    c = graph.read(spark, d, "customer")
    return c.groupBy((F.col("c_nationkey") % 20).alias("p"), F.when(F.col("c_custkey") % 2 == 0, "head").otherwise("tail").alias("direction"), F.concat(F.lit("f"), (F.col("c_custkey") % 4).cast("string")).alias("file"), (F.col("c_custkey") % 4).alias("at")).agg(F.round(F.avg("c_acctbal"), 2).alias("mrr"))


_BEST = f"select p, direction, file from (select *, row_number() over (partition by p, direction order by mrr desc, ord) as rn from ({_CHOICES})) where rn = 1"


@query("{plain}" + _BEST)
def ensemble_best_by_valid(spark, d):
    return compare.best_by(_choices(spark, d), ["p", "direction"], "mrr", "file", "at")


@query("{plain}with b as (" + _BEST + "), top as (select p from (select c_nationkey % 20 as p, count(*) as n from customer group by 1) order by n desc, p desc limit 1), k as (select unnest(range(25)) as p), kd as (select p, unnest(['head', 'tail']) as direction from k) select cast(kd.p as int) as p, kd.direction, coalesce(b.file, f.file) as file, b.file is null as is_fallback from kd left join b using (p, direction) left join (select direction, file from b join top using (p)) f on f.direction = kd.direction")
def ensemble_fallback_relation(spark, d):
    best = compare.best_by(_choices(spark, d), ["p", "direction"], "mrr", "file", "at")
    relations = spark.range(25).select(F.col("id").cast("int").alias("p"), F.explode(F.array(F.lit("head"), F.lit("tail"))).alias("direction"))
    counts = graph.read(spark, d, "customer").groupBy((F.col("c_nationkey") % 20).alias("p")).agg(F.count("*").alias("n"))
    return compare.with_fallback(relations, best, counts, ["p", "direction"], "file")


@query("select q, round(sum(conf) / 10, 9) as m from (select q, conf, row_number() over (partition by q order by conf desc) as rn from fired) where rn <= 10 group by q")
def mean_top10_conf(spark, d):
    top = fired(spark, d).groupBy("q").agg(F.sort_array(F.collect_list("conf"), asc=False).alias("c"))
    return top.select("q", F.round(compare.mean_of_top(F.col("c")), 9).alias("m"))


_RANKED_VECTORS = "select a.vec_id as q, b.vec_id as cand, round(list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as s from embeddings a cross join embeddings b where a.vec_id % 100 = 0"


@query("{plain}select q, cand, pos, score from (select q, cand, s as score, row_number() over (partition by q order by s desc, cand) as pos from (" + _RANKED_VECTORS + ")) where pos <= 10")
def embedding_rank_topk(spark, d):
    """A stated set of queries against all vectors: the first ten by dot product."""
    v = graph.read(spark, d, "embeddings")
    return score.dot_topk(v.filter("vec_id % 100 = 0"), v, 10)


@query("{plain}select q, cand, pos, score from (select q, cand, s as score, row_number() over (partition by q order by s desc, cand) as pos from (" + _RANKED_VECTORS.replace(" where a.vec_id % 100 = 0", "") + ")) where pos <= 10")
def embedding_rank_all(spark, d):
    """Every vector against all vectors, as a product of blocks."""
    v = graph.read(spark, d, "embeddings")
    return score.dot_topk(v, v, 10)


_INDEX = "select p_brand as rel, p_partkey as k, row_number() over (partition by p_brand order by p_partkey) - 1 as local_idx from part"


@query("{plain}select rel, cast(local_idx as bigint) as local_idx, k + 1 as rule_id from (" + _INDEX + ")")
def local_to_global_ids(spark, d):
    """Every rule of the index is in the rule file, in the same order, some with other counts."""
    from pyspark.sql import Window

    part = graph.read(spark, d, "part")
    text = F.concat(F.col("p_brand"), F.lit("(X,Y) <= b"), F.col("p_partkey").cast("string"), F.lit("(X,Y)"))
    index = part.select(F.col("p_brand").alias("rel"), (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("local_idx"), F.col("p_size").alias("num_preds"), F.lit(3).alias("num_true"), text.alias("rule"))
    known = part.select((F.col("p_partkey") + 1).alias("rule_id"), F.col("p_brand").alias("head_rel"), (F.col("p_size") + F.when(F.col("p_partkey") % 4 == 0, 1).otherwise(0)).alias("num_preds"), F.lit(3).alias("num_true"), text.alias("rule"))
    return rules.local_to_global(index, known).select("rel", long("local_idx"), long("rule_id"))
