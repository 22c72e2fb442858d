"""More registered queries: files written and read back, lookups, model scores, checkpoints, reports and fits."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as rule
from ..functions import scores
from ..operators import apply, compare, fit, graph, rules, samples, score
from ..sources import formats
from ..store import saved, tables_dir
from .catalogue import _RULE, _SIDES, _SYN, SHAPE, TERMS, _lift, _pairs, _rule_table, _sides, _train, _two_relations, applied, fired, golds, joined, line_tasks, long, query, shipped


def _fresh(spark, name: str) -> str:
    return f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Files


@query("select direction, p, cast(q as varchar) as q, cast(cand as varchar) as cand, array_to_string(rule_ids, ',') as ids from applied")
def applied_json_round_trip(spark, d):
    path = _fresh(spark, "applied")
    formats.write_applied(applied(spark, d), path)
    return formats.flattened(spark.read.text(path)).select("direction", "p", "q", "cand", joined("rule_ids").alias("ids"))


_RANKED = "select 'tail' as direction, q, cand, row_number() over (partition by q order by s desc, cand) - 1 as pos, s as conf from (select q, cand, max(conf) as s from fired group by q, cand)"


def _ranked_rows(spark, d):
    best = fired(spark, d).groupBy("q", "cand").agg(F.max("conf").alias("score"))
    top, _ = apply.first_unknown(best, graph.read(spark, d, "lineitem").limit(0).select(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("a")), ["q"], 4)
    return top


@query(f"select 'o' || cast(q as varchar) as s, 'shipped_by' as p, 'x' as o, direction, cast(pos as int) as pos, cast(cand as varchar) as cand, conf from ({_RANKED}) where pos < 4")
def ranking_files_round_trip(spark, d):
    """Rankings written as records of three lines and read back; the head side of each is empty."""
    top = _ranked_rows(spark, d).select(F.concat(F.lit("o"), F.col("q").cast("string")).alias("s"), F.lit("shipped_by").alias("p"), F.lit("x").alias("o"), F.lit("tail").alias("direction"), (F.col("pos") - 1).alias("pos"), "cand", F.col("score").alias("conf"))
    path = _fresh(spark, "ranking")
    formats.ranking_records(top.select("s", "p", "o").distinct(), top).select("value").write.text(path)
    return formats.rankings(spark, path).select("s", "p", "o", "direction", F.col("pos").cast("int").alias("pos"), "cand", "conf")


@query(f", r as (select * from ({_RANKED}) where pos < 4), t as (select distinct q, gold from golds) select t.q || '' as s, gold || '' as o, r.cand || '' as cand, r.pos::int as pos, array_to_string(a.rule_ids[:2], ',') as ids from t join r using (q) join applied a on a.q = r.q and a.cand = r.cand")
def explanation_round_trip(spark, d):
    """Explanation records of the test triples, at most two rules a candidate, written and parsed."""
    ranking = _ranked_rows(spark, d).select(F.lit("tail").alias("direction"), F.lit("shipped_by").alias("p"), "q", "cand", "score")
    targets = golds(spark, d).select(F.col("q").cast("string").alias("s"), F.lit("shipped_by").alias("p"), F.col("gold").cast("string").alias("o"))
    path = _fresh(spark, "explanations")
    formats.explained(targets, ranking, applied(spark, d), 2).select("value").write.text(path)
    found = formats.explanations(spark.read.text(path)).filter("direction = 'tail' and cand is not null")
    return found.select("s", "o", "cand", F.col("pos").cast("int").alias("pos"), joined("rule_ids").alias("ids"))


@query(", t as (select p_partkey as line, p_size as support, cast(p_partkey % 90 as double) / 100 as lift, p_partkey % 50 + 1 as rule1, p_partkey * 7 % 50 + 1 as rule2 from part where p_partkey % 9 <> 0) select count(*) as n, cast(sum(support) as bigint) as support, round(sum(lift), 6) as lift, cast(sum(rule1 * 100 + rule2) as bigint) as ids from t")
def synergy_file_read(spark, d):
    """Lines by tabs and by blanks, some of them broken."""
    lines = _lift(spark, d)
    fields = [F.lit("s"), *[F.col(c).cast("string") for c in ("support", "lift", "rule1", "rule2")]]
    text = F.when(F.col("line") % 9 == 0, F.concat_ws("\t", F.lit("s"), F.lit("?"), *fields[2:])).when(F.col("line") % 2 == 0, F.concat_ws("\t", *fields)).otherwise(F.concat_ws("  ", *fields))
    path = _fresh(spark, "synergy")
    lines.select(text.alias("value")).write.text(path)
    found = samples.synergy_lines(formats.numbered_lines(spark, path))
    return found.agg(F.count("*").alias("n"), F.sum("support").alias("support"), F.round(F.sum("lift"), 6).alias("lift"), F.sum(F.col("rule1") * 100 + F.col("rule2")).alias("ids"))


@query(", s as (select q, a, case when part = 0 then 'test' when part = 1 then 'valid' else 'train' end as split from shipped), seen as (select q, a from s where split = 'train'), o as (select split, count(*) as n from s group by 1 union all select split || '_without_unseen', count(*) from s where split <> 'train' and q in (select q from seen) and a in (select a from seen) group by 1 union all select 'train_sample', count(*) from s where split = 'valid') select split, n as triples from o")
def split_files_written(spark, d):
    """The splits with their side outputs, written as triples and counted from their files."""
    t = saved(shipped(spark, d).select(F.concat(F.lit("o:"), F.col("q").cast("string")).alias("s"), F.lit("shipped_by").alias("p"), F.concat(F.lit("s:"), F.col("a").cast("string")).alias("o"), "part"), "shipped")
    splits = graph.split_parts({name: t.filter(part).select("s", "p", "o") for name, part in (("train", "part > 1"), ("valid", "part = 1"), ("test", "part = 0"))})
    path = _fresh(spark, "splits")
    formats.write_splits(splits, path)
    out = None
    for name in splits:
        one = formats.triples(spark, f"{path}/{name}").agg(F.count("*").alias("triples")).select(F.lit(name).alias("split"), "triples")
        out = one if out is None else out.unionByName(one)
    return out


@query("{plain}select cast(c_custkey as varchar) as s, '<' || c_mktsegment || '>' as p, 'a & b' as o from customer")
def triples_unescaped(spark, d):
    """HTML references replaced, and columns brought from the order s, o, p."""
    t = graph.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("x"), F.lit("a &amp; b").alias("y"), F.concat(F.lit("&lt;"), "c_mktsegment", F.lit("&gt;")).alias("z"))
    return formats.unescaped(formats.permuted(t, "sop"))


# Rules

_MORE_RULES = "case p_partkey % 8 when 5 then 'h(X,X) <= b(X,c' || cast(p_partkey % 4 as {S}) || ')' when 6 then 'h(X,X) <= b(X,A)' when 7 then 'h(X,c2) <= ' else (" + _RULE + ") end"
_MORE_LINES = "select cast(p_partkey + 1 as bigint) as rule_id, cast(p_size as bigint) as num_true, " + _MORE_RULES + " as rule from part"


def _more_rules(spark, d):
    graph.read(spark, d, "part").createOrReplaceTempView("_rule_part")
    return spark.sql(_MORE_LINES.format(S="string").replace("from part", "from _rule_part"))


@query("{plain}select rule_id, " + SHAPE + " as shape from (" + TERMS.format(rules=_MORE_LINES.format(S="varchar")) + ")")
def rule_shapes(spark, d):
    return _more_rules(spark, d).select("rule_id", rule.shape(F.col("rule")).alias("shape"))


@query("{plain}select rule_id, coalesce(case when shape = 'cyclic' then num_true >= 5 and n <= 3 else num_true >= 10 end, false) and shape not in ('zero', 'u_xxd') as active from (select *, " + SHAPE + " as shape from (" + TERMS.format(rules=_MORE_LINES.format(S="varchar")) + ")) where shape is not null union all select rule_id, false from (" + _MORE_LINES.format(S="varchar") + ") where rule not like '% <= %'")
def rule_active(spark, d):
    on = tuple(s for s in rule.SHAPES if s not in ("zero", "u_xxd"))
    return _more_rules(spark, d).select("rule_id", rule.is_active(F.col("rule"), F.col("num_true"), on, 5, 10).alias("active"))


@query("{plain}select p_brand as p, count(*) as n, string_agg(cast(p_partkey + 1 as varchar), ',' order by p_partkey) as ids from part group by 1")
def rule_ids_by_relation(spark, d):
    found = rules.ids_by_relation(graph.read(spark, d, "part").select((F.col("p_partkey") + 1).alias("rule_id"), F.col("p_brand").alias("head_rel")))
    return found.select("p", F.size("rule_ids").cast("long").alias("n"), joined("rule_ids").alias("ids"))


@query("{plain}select count(*) as n, max(p_partkey + 1) as max_id from part where p_partkey % 3 <> 0")
def rule_statistics_of_allowed(spark, d):
    """Rules whose ids are allowed: how many, and the largest."""
    part = graph.read(spark, d, "part")
    return rules.statistics(rules.allowed(part.select((F.col("p_partkey") + 1).alias("rule_id")), part.filter("p_partkey % 3 <> 0").select((F.col("p_partkey") + 1).alias("rule_id"))))


@query("select distinct 1 as rule_id, s as x, s as y from triples where p = 'has_brand' union select distinct 2, o, o from triples where p = 'supp_nation'")
def rule_apply_reflexive_dangling(spark, d):
    return apply.reflexive_dangling(spark.createDataFrame([(1, "has_brand", False), (2, "supp_nation", True)], "rule_id int, rel string, inv boolean"), graph.project(spark, d))


@query("{plain}with i as (select p_brand as rel, row_number() over (partition by p_brand order by p_partkey) - 1 as local_idx from part), k as (select p_brand as rel, p_partkey + 1 as rule_id, row_number() over (partition by p_brand order by p_partkey) - 1 as ord from part where p_partkey % 5 <> 0) select i.rel, cast(local_idx as bigint) as local_idx, rule_id from i left join k on k.rel = i.rel and ord = local_idx")
def local_ids_by_position(spark, d):
    """The rule file lacks rules, so the last entries of a relation find none."""
    index, known = _index_and_rules(spark, d)
    return rules.by_position(index, known).select("rel", long("local_idx"), long("rule_id"))


def _index_and_rules(spark, d):
    part = graph.read(spark, d, "part")
    text = F.concat(F.lit("h(X,Y) <= b"), (F.col("p_partkey") % 4).cast("string"), F.lit("(X,Y)"))

    at = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    index = part.select(F.col("p_brand").alias("rel"), at.alias("local_idx"), F.col("p_size").alias("num_preds"), F.lit(3).alias("num_true"), text.alias("rule"))
    known = part.filter("p_partkey % 5 <> 0").select((F.col("p_partkey") + 1).alias("rule_id"), F.col("p_brand").alias("head_rel"), F.col("p_size").alias("num_preds"), F.lit(3).alias("num_true"), text.alias("rule"))
    return index, known


@query("{plain}select rel, local_idx, cast(row_number() over (order by rel, local_idx) - 1 as bigint) as global_idx from (select p_brand as rel, cast(row_number() over (partition by p_brand order by p_partkey) - 1 as bigint) as local_idx from part)")
def index_numbered_strictly(spark, d):
    index, _ = _index_and_rules(spark, d)
    return rules.strictly_indexed(index).select("rel", long("local_idx"), long("global_idx"))


# Samples and lookups


@query("select q, count(*) as n, cast(min(cand) as bigint) as first, min(cand) = any_value(target) as is_first, array_to_string(list(array_to_string(rule_ids, '+') order by cand), ',') as lists from (select *, max(cand) over (partition by q) as target from applied) group by q")
def applied_arrays_by_key(spark, d):
    a = samples.arrays_by_key(applied(spark, d)).withColumn("target", F.array_max("cands"))
    lists = F.array_join(F.transform("rules", lambda r: F.array_join(F.transform(r, lambda x: x.cast("string")), "+")), ",")
    return a.select("q", F.size("cands").cast("long").alias("n"), F.col("cands")[0].alias("first"), (samples.first_position("cands", "target") == 0).alias("is_first"), lists.alias("lists"))


@query("select max(len(rule_ids))::int as longest from applied")
def longest_rule_list(spark, d):
    return samples.longest_list(applied(spark, d))


_WEIGHTS = "select distinct rule_id, conf * 2 as weight from fired where rule_id % 3 <> 0"


def _weights(spark, d):
    return _rule_table(spark, d).filter("rule_id % 3 <> 0").select("p", "rule_id", (F.col("conf") * 2).alias("weight"))


@query("select q, cand, rule_id, round(conf, 9) as conf from fired")
def rule_confidence_lookup(spark, d):
    return score.with_value(applied(spark, d), _rule_table(spark, d), "conf").select("q", "cand", "rule_id", F.round("conf", 9).alias("conf"))


@query(f", w as ({_WEIGHTS}) select a.q, a.cand, round(coalesce(sum(weight), 0), 9) as score from applied a left join fired f on f.q = a.q and f.cand = a.cand left join w on w.rule_id = f.rule_id group by all")
def rule_weight_lookup(spark, d):
    """Rules without a weight count nothing; candidates of such rules only have score 0."""
    sums = score.value_sums(applied(spark, d), _weights(spark, d), "weight", ["p", "q", "cand"])
    return sums.select("q", "cand", F.round("score", 9).alias("score"))


@query(f", w as ({_WEIGHTS}), z as (select a.q, a.cand, coalesce(sum(weight), 0) as s from applied a left join fired f on f.q = a.q and f.cand = a.cand left join w on w.rule_id = f.rule_id group by all) select q, cand, round(1 / (1 + exp(-(s - 0.5))), 9) as pred from z")
def score_linear_sigmoid(spark, d):
    """The linear model's prediction; a candidate whose rules all have no weight gets that of the bias alone."""
    sums = score.value_sums(applied(spark, d), _weights(spark, d), "weight", ["p", "q", "cand"])
    return sums.select("q", "cand", F.round(scores.sigmoid(F.col("score") - 0.5), 9).alias("pred"))


@query(_SYN + ", g as (select x.q, x.cand, sum(lift) as extra from sy join fired x on x.rule_id = sy.a join fired y on y.rule_id = sy.b and y.q = x.q and y.cand = x.cand group by all) select q, cand, round(greatest(1e-7, least(1 - 1e-7, 1 - exp(sum(ln(1 - conf)) - 0.7 * coalesce(any_value(extra), 0) - 0.09)))), 9) as score from fired left join g using (q, cand) group by q, cand".replace("0.09)))), 9)", "0.09))), 9)"))
def score_surprisal_bias_gamma(spark, d):
    syn = samples.synergy_pairs(_lift(spark, d), _two_relations(spark)).withColumn("p", F.lit("shipped_by"))
    extra = samples.pairs_in(applied(spark, d), syn).groupBy("q", "cand").agg(F.sum("lift").alias("extra"))
    f = fired(spark, d).withColumn("weight", scores.surprisal(F.col("conf"))).join(extra, ["q", "cand"], "left")
    return f.groupBy("q", "cand").agg(F.round(scores.surprisal_score(0.3, 0.7, pairs=F.coalesce(F.first("extra"), F.lit(0.0))), 9).alias("score"))


_PRED = "select q, cand, 1 - exp(sum(ln(1 - conf))) as pred, case when (q, cand) in (select (q, gold) from golds) then 1 else 0 end as gold from fired group by q, cand"


@query(f", x as ({_PRED}) select round(avg(case when (pred > 0.5) = (gold = 1) then 1.0 else 0.0 end), 9) as accuracy, round(avg(-(gold * ln(pred) * 5 + (1 - gold) * ln(1 - pred))), 6) as mean_loss from x")
def accuracy_at_half(spark, d):
    pred = fired(spark, d).groupBy("q", "cand").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("pred"))
    gold = golds(spark, d).withColumnRenamed("gold", "cand").withColumn("gold", F.lit(1))
    found = score.accuracy(pred.join(gold, ["q", "cand"], "left").withColumn("gold", F.coalesce("gold", F.lit(0))))
    return found.select(F.round("accuracy", 9).alias("accuracy"), F.round("mean_loss", 6).alias("mean_loss"))


@query(f", sc as (select q, cand, max(conf) as s from fired group by q, cand), pre as (select * from (select *, row_number() over (partition by q order by s desc, cand) as n from sc) where n <= 5), top as (select *, row_number() over (partition by q order by s desc, cand) as pos from pre anti join known using (q, cand)) select q, cand, round(s, 9) as score, pos, coalesce(m, 0) < 3 as short from top left join (select q, count(*) as m from top where pos <= 3 group by q) using (q) where pos <= 3")
def first_unknown_after_cut(spark, d):
    """The first three unknown of the first five, and whether a query has fewer."""
    best = fired(spark, d).groupBy("q", "cand").agg(F.max("conf").alias("score"))
    top, short = apply.first_unknown(best, shipped(spark, d).filter("part > 0"), ["q"], 3, 5)
    return top.join(short.select("q", F.lit(True).alias("short")), "q", "left").select("q", "cand", F.round("score", 9).alias("score"), long("pos"), F.coalesce("short", F.lit(False)).alias("short"))


# Checkpoints and times

_EVALS = "select c_nationkey as p, case when c_custkey % 2 = 0 then 'head' else 'tail' end as direction, cast(c_custkey % 9 as int) as epoch, round(avg(c_acctbal) / 10000, 3) as mrr from customer group by all"


def _evals(spark, d):
    return graph.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("p"), F.when(F.col("c_custkey") % 2 == 0, "head").otherwise("tail").alias("direction"), (F.col("c_custkey") % 9).cast("int").alias("epoch")).agg(F.round(F.avg("c_acctbal") / 10000, 3).alias("mrr"))


@query("{plain}select p, direction, epoch, mrr from (select *, row_number() over (partition by p, direction order by mrr desc, epoch) as n from (" + _EVALS + ")) where n = 1")
def best_checkpoint(spark, d):
    return score.best_checkpoint(_evals(spark, d), ["p", "direction"])


@query("{plain}with b as (select *, max(mrr) over (partition by p, direction order by epoch) as best from (" + _EVALS + ")), m as (select p, epoch, round(sum(greatest(best, -1)) / 2, 9) as m from b group by all), r as (select *, m > lag(m, 1, -1) over (partition by p order by epoch) as rise, row_number() over (partition by p order by epoch) as n from m), w as (select *, n - coalesce(max(case when rise then n end) over (partition by p order by epoch), 0) as waited from r) select p, min(case when waited >= 3 then epoch end) as epoch from w group by p")
def stopping_epoch(spark, d):
    return score.stopping_epoch(_evals(spark, d), 3, "mrr")


@query("{plain}select count(*) as relations, round(sum(total), 6) as total, round(sum(eval), 6) as eval from (select c_nationkey, sum(c_acctbal) as total, sum(c_acctbal) / 4 as eval from customer group by 1)")
def time_rollup(spark, d):
    """Reports of all relations written as JSON, read back and summed."""
    per = graph.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("p")).agg(F.sum("c_acctbal").alias("t")).select("p", F.struct(F.col("t").alias("total"), (F.col("t") / 4).alias("eval")).alias("time_seconds"))
    path = _fresh(spark, "metrics")
    formats.write_metrics(per, path)
    read = spark.read.schema(per.schema).json(path)
    found = score.time_rollup(read.select("time_seconds.*"), ["total", "eval"])
    return found.select("relations", F.round("total", 6).alias("total"), F.round("eval", 6).alias("eval"))


# Comparison


@query("select level, count(*) as keys, cast(sum(n) as bigint) as entries from (select 'direction' as level, count(*) as n from applied group by direction union all select 'relation', count(*) from applied group by direction, p union all select 'query', count(*) from applied group by direction, p, q union all select 'candidate', count(*) from applied group by direction, p, q, cand) group by level")
def entry_counts_all_levels(spark, d):
    return compare.counts_by_level(applied(spark, d)).select("level", "keys", long("entries"))


@query(_SIDES + " select (select count(*) from ra) as a, (select count(*) from rb) as b, (select count(*) from ra semi join rb using (q, cand)) as common")
def summary_counts(spark, d):
    return compare.summary(*_sides(spark, d), line_tasks(spark, d))


_DATASETS = ", ds as (select l_orderkey as sample, list(l_linenumber order by l_linenumber, l_partkey) as r, max(l_partkey) % 2 as g from lineitem group by 1)"


def _dataset(spark, d):
    rows = graph.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").cast("int").alias("n"), "l_partkey"))).alias("x"), (F.max("l_partkey") % 2).alias("gold"))
    return rows.select("sample", F.col("x.n").alias("rule_ids"), "gold")


@query(_DATASETS + " select sample, case when sample % 11 = 0 then 'missing' when sample % 13 = 0 then 'gold' when sample % 17 = 0 then 'length' else 'rules' end as what from ds where sample % 11 = 0 or sample % 13 = 0 or sample % 17 = 0 or (sample % 19 = 0 and len(r) > 0)")
def sample_differences(spark, d):
    """A dataset against itself with samples taken out, golds turned, lists made longer and ids changed."""
    one = _dataset(spark, d)
    turned = F.when(F.col("sample") % 13 == 0, 1 - F.col("gold")).otherwise(F.col("gold"))
    changed = F.when(F.col("sample") % 17 == 0, F.concat("rule_ids", F.array(F.lit(7)))).when(F.col("sample") % 19 == 0, F.transform("rule_ids", lambda x: x + 1)).otherwise(F.col("rule_ids"))
    two = one.filter("sample % 11 <> 0").select("sample", changed.alias("rule_ids"), turned.alias("gold"))
    return compare.sample_differences(one, two)


@query(_DATASETS + " select sample from ds where sample % 11 = 0 or sample % 13 = 0 order by sample limit 5")
def first_mismatches(spark, d):
    one = _dataset(spark, d)
    two = one.filter("sample % 11 <> 0").withColumn("gold", F.when(F.col("sample") % 13 == 0, 1 - F.col("gold")).otherwise(F.col("gold")))
    return compare.first_of(compare.sample_differences(one, two).select("sample"), 5, ["sample"])


@query(_SIDES + ", qa as (select distinct q from ra), qb as (select distinct q from rb) select 'missing_query' as section, count(*) as n from qa anti join qb using (q) union all select 'extra_query', count(*) from qb anti join qa using (q) union all select 'missing', count(*) from ra anti join rb using (q, cand) union all select 'extra', count(*) from rb anti join ra using (q, cand) union all select 'rules', count(*) from ra join rb using (q, cand) where ra.r <> rb.r")
def comparison_report(spark, d):
    """The report of two applied-rules tables, written and read back, by section."""
    sides = [saved(side, f"side{n}") for n, side in enumerate(_sides(spark, d))]
    path, tasks = _fresh(spark, "report"), line_tasks(spark, d)
    formats.write_report(compare.report_counts(*sides, tasks), compare.report(*sides, tasks), path)
    return spark.read.json(f"{path}/differences").groupBy("section").agg(F.count("*").alias("n"))


# Files read over splits


@query("{plain}select p_brand as rel, (row_number() over (partition by p_brand order by p_partkey) - 1)::int as local_idx, p_partkey as num_preds, p_size::bigint as num_true, 'h(X,Y) <= ' || p_type || '(X,Y)' as rule from part")
def rule_index_over_splits(spark, d):
    """A rule index of all parts in one file a first letter, a block a brand, written and read back in splits."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    part = graph.read(spark, d, "part").withColumn("n", F.row_number().over(w) - 1)
    line = F.concat_ws("\t", F.col("n").cast("string"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.lit("0.5"), F.concat(F.lit("h(X,Y) <= "), "p_type", F.lit("(X,Y)")))
    heads = part.select("p_brand").distinct().select("p_brand", F.lit(-1).alias("n"), F.concat(F.lit(">>>"), "p_brand").alias("value"))
    path = _fresh(spark, "index")
    rows = part.select("p_brand", "n", line.alias("value")).unionByName(heads).withColumn("letter", F.substring("p_brand", 1, 7))
    rows.repartition("letter").sortWithinPartitions("letter", "p_brand", "n").select("letter", "value").write.partitionBy("letter").text(path)
    return formats.rule_index_files(spark, path).drop("file")


@query("{plain}select c_mktsegment as segment, 'tail' as direction, 'in \"' || c_mktsegment || '\"' as p, 'q}' || cast(c_custkey as varchar) as q, 'c{' || cast(c_nationkey as varchar) as cand, cast(c_custkey % 9 as varchar) || ',7' as ids from customer")
def applied_object_over_splits(spark, d):
    """Applied rules as one nested object a segment, written and cut again at its queries; names hold braces and quotes."""
    c = graph.read(spark, d, "customer")
    entry = F.concat(F.lit('"q}'), F.col("c_custkey").cast("string"), F.lit('": {"c{'), F.col("c_nationkey").cast("string"), F.lit('": ['), (F.col("c_custkey") % 9).cast("string"), F.lit(", 7]},"))
    rows = c.select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("n"), entry.alias("value"))
    ends = c.select(F.col("c_mktsegment").alias("segment")).distinct()
    begin = ends.select("segment", F.lit(-1).cast("long").alias("n"), F.concat(F.lit('{"head": {}, "tail": {"in \\"'), "segment", F.lit('\\"": {')).alias("value"))
    end = ends.select("segment", F.lit(2**62).alias("n"), F.lit('"nobody": {}}}}').alias("value"))
    path = _fresh(spark, "object")
    rows.unionByName(begin).unionByName(end).repartition("segment").sortWithinPartitions("segment", "n").select("segment", "value").write.partitionBy("segment").text(path)
    found = formats.applied_files(spark, path)
    return found.select(F.regexp_extract("file", "segment=([^/]*)/", 1).alias("segment"), "direction", "p", "q", "cand", joined("rule_ids").alias("ids"))


# Fits


def _steps_sql(steps: int, linear: bool, batches: bool = False, bias: str = "0.0") -> str:
    """Adam's first steps from the definition: ``rule_id, trained`` after them; over all samples, or each over a batch of their order."""
    batch = lambda k: f"where batch = {k - 1}" if batches else ""
    z0 = "sum(x * x) + any_value(b)" if linear else "sum(x * x) + any_value(b) * any_value(b)"
    pred = "1 / (1 + exp(-z))" if linear else "1 - exp(-z)"
    dz = "neg * pred - 5 * pos * (1 - pred)" if linear else "neg - 5 * pos * (1 - pred) / pred"
    start = "sqrt(conf)" if linear else "sqrt(-ln(1 - conf))"
    db = "sum(dz)" if linear else "2 * any_value(b) * sum(dz)"
    out = f""", sm as (select a.q, a.cand, case when s.part > 1 then 1 else 0 end as gold, f.rule_id from applied a join fired f on f.q = a.q and f.cand = a.cand join shipped s on s.q = a.q and s.a = a.cand where a.q in (select q from shipped where part > 1)),
 na as (select q, cand, (row_number() over (order by q, cand) - 1) // ((count(*) over () + {steps - 1}) // {steps}) as batch from (select distinct q, cand from sm)),
 ex as (select rule_id, q, cand, gold as pos, 1 - gold as neg, batch from sm join na using (q, cand)),
 x0 as (select distinct rule_id, {start} as x, 0.0::double as m, 0.0::double as v, ({bias})::double as b, 0.0::double as bm, 0.0::double as bv from fired)"""
    for k in range(1, steps + 1):
        out += f""",
 z{k} as (select q, cand, any_value(pos) as pos, any_value(neg) as neg, any_value(b) as b, {z0} as z from ex join x{k - 1} using (rule_id) {batch(k)} group by q, cand), tot{k} as (select count(*) as t from z{k}),
 p{k} as (select *, {pred} as pred from z{k}), d{k} as (select *, {dz} as dz from p{k}),
 gb{k} as (select {db} / (select t from tot{k}) as gb from d{k}),
 gr{k} as (select rule_id, sum(dz) as s from ex join d{k} using (q, cand) group by rule_id),
 y{k} as (select r.rule_id, x, b, 0.9 * m + 0.1 * g as m, 0.999 * v + 0.001 * g * g as v, 0.9 * bm + 0.1 * gb as bm, 0.999 * bv + 0.001 * gb * gb as bv from (select x{k - 1}.*, 2 * x * coalesce(s, 0) / (select t from tot{k}) as g from x{k - 1} left join gr{k} using (rule_id)) r, gb{k}),
 x{k} as (select rule_id, x - 0.01 * (m / (1 - pow(0.9, {k}))) / (sqrt(v / (1 - pow(0.999, {k}))) + 1e-8) as x, m, v, b - 0.01 * (bm / (1 - pow(0.9, {k}))) / (sqrt(bv / (1 - pow(0.999, {k}))) + 1e-8) as b, bm, bv from y{k})"""
    return out + f" select rule_id::bigint as rule_id, round(x * x, 6) as trained from x{steps}"


@query(_steps_sql(3, True))
def fit_linear_three_steps(spark, d):
    return fit.fit(_train(spark, d), _rule_table(spark, d), "linear", epochs=3, rates=(0.01,)).select(long("rule_id"), F.round("trained", 6).alias("trained"))


@query(_steps_sql(3, False))
def fit_surprisal_three_steps(spark, d):
    return fit.fit(_train(spark, d), _rule_table(spark, d), "surprisal", epochs=3, rates=(0.01,)).select(long("rule_id"), F.round("trained", 6).alias("trained"))


#: What a bias drawn by the seed 0 begins with: the same digits of the same digest.
_DRAWN = "(2 * (('0x' || substr(sha256('0:shipped_by'), 1, 8))::bigint / 4294967296.0) - 1) / sqrt((select count(distinct rule_id) from fired))"


def _batched(spark, d):
    """The training samples in order, and a third of their number."""
    rows = _train(spark, d).withColumn("ord", F.col("q") * 10_000_000 + F.col("cand"))
    return rows, -(-rows.count() // 3)


@query(_steps_sql(3, True, True, _DRAWN))
def fit_linear_three_batches(spark, d):
    """An epoch of three mini-batches in the order of the samples, from a bias drawn by a seed."""
    rows, batch = _batched(spark, d)
    return fit.fit(rows, _rule_table(spark, d), "linear", epochs=1, rates=(0.01,), bias=None, batch=batch).select(long("rule_id"), F.round("trained", 6).alias("trained"))


@query(_steps_sql(3, False, True))
def fit_surprisal_three_batches(spark, d):
    """The same with the relation kept as a distributed table, a job a batch."""
    rows, batch = _batched(spark, d)
    return fit.fit(rows, _rule_table(spark, d), "surprisal", epochs=1, rates=(0.01,), batch=batch, whole_values=0).select(long("rule_id"), F.round("trained", 6).alias("trained"))


@query()
def fit_grid(spark, d):
    """Forty settings of the linear model fitted in one scan of the samples."""
    options = {"positive_weight": [5.0, 15.0, 30.0, 100.0, 400.0], "rates": [(0.001,), (0.01,)], "epochs": [10, 20], "constrained": [True, False]}
    return fit.tuned(_train(spark, d), _rule_table(spark, d), options)


@query()
def fit_surprisal_with_pairs(spark, d):
    """Pair weights and gamma beside the rules' weights."""
    syn = samples.synergy_pairs(_lift(spark, d), _two_relations(spark)).withColumn("p", F.lit("shipped_by"))
    fitted = fit.train(_train(spark, d), _rule_table(spark, d), "surprisal", epochs=10, pairs=syn)
    return fitted.pairs.join(F.broadcast(fitted.relations), "p").select("p", "a", "b", "original", "trained", "gamma", "first_loss", "last_loss")  # a row for each relation


@query(f", pr as (select distinct 'shipped_by' as p, least(x, y) as a, greatest(x, y) as b from (select cast(p_partkey % 50 + 1 as int) as x, cast(p_partkey * 7 % 50 + 1 as int) as y from part)) select p, a, b, 0.5 as original, 0 as hits from pr".replace("0.5 as original, 0 as hits", "cast(0.5 as double) as original, cast(0 as bigint) as hits"))
def synergy_weights_written(spark, d):
    """Pair weights as CSV by relation, with no training hits, read back."""
    pairs = _pairs(spark, d)
    path = _fresh(spark, "weights")
    formats.write_synergy(pairs.withColumns({"original": F.lit(0.5), "trained": F.lit(0.25)}), pairs.limit(0).withColumn("train_hit_count", F.lit(0).cast("long")), path)
    back = spark.read.csv(path, header=True, schema="rule1ID int, rule2ID int, original double, trained double, train_hit_count long, p string")
    return back.select("p", F.col("rule1ID").alias("a"), F.col("rule2ID").alias("b"), "original", F.col("train_hit_count").alias("hits"))
