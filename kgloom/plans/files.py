"""Registered queries over files that are written from the tables and read back, and over what goes into them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as rule
from ..operators import apply, fit, graph, samples
from ..sources import formats
from ..store import saved
from .catalogue import _SYN, SHAPE, TERMS, _lift, _rule_table, _train, _two_relations, applied, fired, joined, long, query, shipped
from .further import _MORE_LINES, _fresh, _more_rules, _steps_sql


@query("select cast(row_number() over (order by token) - 1 as bigint) as id, token from (select s as token from triples union select o from triples)")
def id_map_round_trip(spark, d):
    """The entities of all relations as an id map, written in the order of ids and read back."""
    path = _fresh(spark, "ids")
    formats.write_ids(graph.sorted_dictionary(graph.projected(spark, d)), path)
    return formats.ids(spark, path).select(long("id"), "token")


@query("{plain}select cast(c_custkey as varchar) as id, c_mktsegment as token from customer where c_custkey % 4 < 2")
def mapping_lines_read(spark, d):
    """Lines of two fields between tabs or blanks; lines of one field and of three are dropped."""
    c = graph.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("k"), (F.col("c_custkey") % 4).alias("n"), "c_mktsegment")
    text = F.when(F.col("n") == 0, F.concat_ws("\t", "k", "c_mktsegment")).when(F.col("n") == 1, F.concat(F.lit("  "), F.concat_ws("   ", "k", "c_mktsegment"), F.lit(" "))).when(F.col("n") == 2, F.concat_ws(" ", "k", "c_mktsegment", "k")).otherwise(F.col("k"))
    path = _fresh(spark, "mapping")
    c.select(text.alias("value")).write.text(path)
    return formats.mapping(spark, path)


@query("select s, p, o from triples")
def triples_strict_round_trip(spark, d):
    """All triples as lines, read by the strict reader, for which any other line is an error."""
    path = _fresh(spark, "triples")
    formats.write_triples(graph.project(spark, d), path)
    return formats.triples(spark, path, strict=True)


_SPLIT = "(select 'train' as split, s, p, o from triples union all select case when part = 0 then 'test' else 'valid' end, 'o:' || cast(q as varchar), 'shipped_by', 's:' || cast(a as varchar) from shipped where part < 2)"


@query(f", x as (select unnest([split, 'all']) as split, s, p, o from {_SPLIT}), e as (select split, count(distinct e) as entities from (select split, unnest([s, o]) as e from x) group by 1) select split, split as file, count(*) as triples, any_value(entities) as entities, count(distinct p) as relations from x join e using (split) group by split")
def dataset_descriptor(spark, d):
    """Splits written as triples, and the descriptor beside them read back: triples, entities and relations of each and of all."""
    held = saved(shipped(spark, d).filter("part < 2").select(F.concat(F.lit("o:"), F.col("q").cast("string")).alias("s"), F.lit("shipped_by").alias("p"), F.concat(F.lit("s:"), F.col("a").cast("string")).alias("o"), "part"), "held")
    path = _fresh(spark, "dataset")
    formats.write_splits({"train": graph.project(spark, d), "valid": held.filter("part = 1").select("s", "p", "o"), "test": held.filter("part = 0").select("s", "p", "o")}, path)
    return spark.read.schema("split string, file string, triples long, entities long, relations long").json(f"{path}/dataset.json")


@query("select p, count(*) as n, min(s) as first, max(o) as last from triples group by p")
def dataset_by_relation(spark, d):
    """Triples in a folder for each relation, each folder read by itself through its partition."""
    path = _fresh(spark, "relations")
    formats.write_by_relation(graph.project(spark, d), path)
    return spark.read.schema("s string, o string, p string").parquet(path).groupBy("p").agg(F.count("*").alias("n"), F.min("s").alias("first"), F.max("o").alias("last"))


_HITS = "select rule_id, count(*) as n from (select distinct f.q, f.cand, rule_id from fired f join shipped s on s.q = f.q and s.a = f.cand where part > 1) group by 1"


@query(_steps_sql(3, True).replace(" select rule_id::bigint as rule_id, round(x * x, 6) as trained from x3", f", hits as ({_HITS}) select x3.rule_id::bigint as rule_id, round(c.conf, 7) as original, round(x * x, 7) as trained, coalesce(hits.n, 0) as train_hit_count from x3 join (select distinct rule_id, conf from fired) c using (rule_id) left join hits using (rule_id)"))
def fitted_weights_written(spark, d):
    """Weights after three steps, with the training hits of each rule, as CSV by relation and read back."""
    rows, known = _train(spark, d), _rule_table(spark, d)
    path = _fresh(spark, "weights")
    formats.write_weights(fit.fit(rows, known, "linear", epochs=3, rates=(0.01,)), samples.hit_counts(rows, known), path)
    back = spark.read.csv(path, header=True, schema="ruleID long, original double, trained double, train_hit_count long, p string")
    return back.select(F.col("ruleID").alias("rule_id"), "original", "trained", "train_hit_count")


_SIDED = "select direction, q, cand, row_number() over (partition by direction, q order by s desc, cand) - 1 as pos, s as conf from (select 'tail' as direction, q, cand, max(conf) as s from fired group by q, cand union all select 'head', q, cand, min(conf) from fired where cand % 3 <> 0 group by q, cand)"


@query(f"select 'o' || cast(q as varchar) as s, direction, cast(pos as int) as pos, cast(cand as varchar) as cand, conf from ({_SIDED}) where pos < 3")
def ranking_files_both_sides(spark, d):
    """Rankings of both sides, a text file among others in its folder that the name rules out, the first three read."""
    rows = fired(spark, d, "q").groupBy("q", "cand").agg(F.max("conf").alias("tail"), F.min("conf").alias("head"))
    rows = rows.select("q", "cand", F.explode(F.create_map(F.lit("tail"), "tail", F.lit("head"), F.when(F.col("cand") % 3 != 0, F.col("head")))).alias("direction", "conf")).dropna()
    best = apply.maxplus_topk(rows.select("direction", "q", "cand", F.lit(1).alias("rule_id"), "conf"), ["direction", "q"], 5)
    ranked = saved(best.select(F.concat(F.lit("o"), F.col("q").cast("string")).alias("s"), F.lit("shipped_by").alias("p"), F.lit("x").alias("o"), "direction", (F.col("pos") - 1).alias("pos"), "cand", F.col("confs")[0].alias("conf")), "ranked")
    path = _fresh(spark, "rankings")
    formats.ranking_records(ranked.select("s", "p", "o").distinct(), ranked).select("value").write.text(path)
    ranked.write.mode("append").json(path)
    return formats.rankings(spark, path, 3, "*.txt").select("s", "direction", F.col("pos").cast("int").alias("pos"), "cand", "conf")


@query("{plain}select rule, count(*) as n from (select *, " + SHAPE + " as shape from (" + TERMS.format(rules=_MORE_LINES.format(S="varchar")) + ")) where not coalesce(case when shape = 'cyclic' then num_true >= 5 and n <= 3 else num_true >= 10 end and shape in ('cyclic', 'u_c', 'u_d', 'zero', 'u_xxc', 'u_xxd'), false) group by rule")
def removed_rules_written(spark, d):
    """The texts of rules that the filter removes, a line each, read back and counted."""
    path = _fresh(spark, "removed")
    found = _more_rules(spark, d)
    formats.write_removed(found.filter(~rule.is_active(F.col("rule"), F.col("num_true"), tuple(rule.SHAPES), 5, 10)), path)
    return spark.read.text(path).groupBy(F.col("value").alias("rule")).agg(F.count("*").alias("n"))


@query("select q, cand, array_to_string([x - 20 for x in rule_ids if x > 20], ',') as ids from applied")
def positive_rule_ids(spark, d):
    """Rule ids of 0 and less taken out; candidates without any other stay, with none."""
    moved = applied(spark, d).withColumn("rule_ids", F.transform("rule_ids", lambda x: x - 20))
    return apply.positive_ids(moved).select("q", "cand", joined("rule_ids").alias("ids"))


@query(_SYN + ", d as (select r, count(*) as d from (select a as r from sy union all select b from sy where a <> b) group by 1) select 'p' || cast(a % 2 as varchar) as p, a, b, round(lift / sqrt(x.d * y.d), 9) as lift from sy join d x on x.r = a join d y on y.r = b")
def synergy_degree_normalised(spark, d):
    """The lift of synergy pairs over the square root of the product of their rules' degrees."""
    pairs = samples.synergy_pairs(_lift(spark, d), _two_relations(spark))
    return samples.degree_normalised(pairs, 0.5).select("p", "a", "b", F.round("lift", 9).alias("lift"))


@query(", e as (select s_suppkey as a, s_nationkey as k from supplier), r as (select distinct k from e join fired on cand = a), sm as (select distinct k from e join fired on cand = a where q in (select q from shipped where part > 1)) select * from (select 'n' || cast(k as varchar) as p, case when k % 5 < 2 or k not in (from r) then 'no rules' when k % 5 = 2 or k not in (from sm) then 'no samples' end as error from (select distinct k from e)) where error is not null")
def failed_relations(spark, d):
    """A relation for each nation of a supplier: two in five without rules, one in five without samples, and why each has no fit."""
    nation = graph.read(spark, d, "supplier").select(F.col("s_suppkey").alias("cand"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("p"), (F.col("s_nationkey") % 5).alias("k"))
    rows = _train(spark, d).drop("p").join(nation, "cand").filter("k <> 2").select("p", "rule_ids", "gold")
    known = saved(fired(spark, d).join(nation.filter("k > 1"), "cand").select("p", "rule_id", "conf").distinct(), "known")
    return fit.failed(fit.train(rows, known, "linear", epochs=1, rates=(0.01,)), nation.select("p"))


def _bias_sql(name: str, linear: bool) -> str:
    """A relation of the bias after three steps."""
    steps, _, _ = _steps_sql(3, linear).rpartition(" select rule_id::bigint")
    return f", {name} as (with {steps.lstrip(', ')} select any_value(b) as b from x3)"


@query(_bias_sql("lin", True) + _bias_sql("sur", False) + " select 0 as run, 'linear' as model, round(b, 6) as bias from lin union all select 1, 'surprisal', round(b, 6) from sur")
def fit_grid_three_steps(spark, d):
    """A grid of two models, three steps each, in one scan of the samples: their biases are those of single fits."""
    found = fit.tuned(_train(spark, d), _rule_table(spark, d), {"model": ["linear", "surprisal"]}, epochs=3, rates=(0.01,))
    return found.select("run", F.get_json_object("options", "$.model").alias("model"), F.round("bias", 6).alias("bias"))
