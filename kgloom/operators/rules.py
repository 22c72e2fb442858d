"""Horn rules as tables: reading, filtering, numbering and mapping ids.

A rule line is ``num_preds, num_true, conf, rule`` and its id the 1-based number
of the line in its file, blank lines counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import confidence, count_of, head_relation, is_trivial
from ..store import saved


def from_lines(lines: DataFrame) -> DataFrame:
    """Rules of the lines of rule files (``line`` from 1, ``value``, as of :func:`kgloom.sources.formats.numbered_lines`).

    ``rule_id, num_preds, num_true, conf, rule, head_rel``; other columns stay.  Lines of less than 4 fields are skipped but counted.
    """
    tabs, blanks = F.split("value", "\t"), F.split(F.trim("value"), r"\s+", 4)
    fields = F.when(F.size(tabs) >= 4, tabs).otherwise(blanks)
    others = [c for c in lines.columns if c not in ("line", "value")]
    rows = lines.select(F.col("line").alias("rule_id"), fields.alias("f"), *others).filter(F.size("f") >= 4)
    out = rows.select("rule_id", count_of(F.get("f", F.lit(0))).alias("num_preds"), count_of(F.get("f", F.lit(1))).alias("num_true"), F.get("f", F.lit(3)).alias("rule"), *others)
    return out.select("rule_id", "num_preds", "num_true", confidence(F.col("num_preds"), F.col("num_true")).alias("conf"), "rule", head_relation(F.col("rule")).alias("head_rel"), *others)


def signatures(rules: DataFrame) -> DataFrame:
    """``rel, rule_id, full, rule``: what rules are matched by, the counts and the text, or the text alone."""
    return rules.select(F.col("head_rel").alias("rel"), "rule_id", F.concat_ws("\t", "num_preds", "num_true", "rule").alias("full"), "rule")


def statistics(rules: DataFrame) -> DataFrame:
    """``n, max_id``: how many rules there are, and the largest id."""
    return rules.agg(F.count("*").alias("n"), F.max("rule_id").alias("max_id"))


def allowed(rules: DataFrame, ids: DataFrame) -> DataFrame:
    """The rules whose id is in ``ids`` (``rule_id``)."""
    return rules.join(ids.select("rule_id").distinct(), "rule_id", "left_semi")


def ids_by_relation(rules: DataFrame) -> DataFrame:
    """``p, rule_ids``: the ids of each head relation in order.  A relation has as many entries as the rule files give it."""
    return rules.groupBy(F.col("head_rel").alias("p")).agg(F.sort_array(F.collect_list("rule_id")).alias("rule_ids"))


def renumbered(rules: DataFrame) -> DataFrame:
    """``old_id, new_id`` (from 0) of the rules that are not trivial, by head relation and id."""
    from .graph import numbered

    kept = rules.filter(~is_trivial(F.col("rule"))).select(F.col("rule_id").alias("old_id"), "head_rel")
    return numbered(kept, [F.col("head_rel"), F.col("old_id")], "new_id").select("old_id", "new_id")


def local_to_global(index: DataFrame, rules: DataFrame) -> DataFrame:
    """``rel, local_idx, rule_id``: rules of an index (``rel, local_idx, num_preds, num_true, rule``) as ids of the rule file.

    In a relation the entries of the index, in their order, take the first line that is
    not taken yet with their full signature, else with their text, else the line at
    their position if it is free, else the first free one; none left is an error.

    This is worked out for all relations at once, in rounds of bids (:func:`_round`); lines that a
    round gives are not free in the next one.  Entries that find their full signature, each occurrence its
    own, are matched by one join before the first round, in relations where all do.  A relation takes a round for
    each entry that has to leave its own line, text or position, not for each entry.
    """
    left = index.select("rel", "local_idx", F.concat_ws("\t", "num_preds", "num_true", "rule").alias("full"), "rule")
    right = signatures(rules)
    w = lambda order: Window.partitionBy("rel", "full").orderBy(order)
    a, b = left.withColumn("rn", F.row_number().over(w("local_idx"))), right.withColumn("rn", F.row_number().over(w("rule_id")))
    found = saved(a.join(b.select("rel", "full", "rn", "rule_id"), ["rel", "full", "rn"], "left").select("rel", "local_idx", "rule_id"), "matched")
    unmatched = found.filter("rule_id is null").select("rel").distinct()
    done = found.join(unmatched, "rel", "left_anti")
    places = Window.partitionBy("rel").orderBy("rule_id")
    # each entry takes a line of its own, so relations with more entries than lines are errors, raised where the result is read
    many, enough = left.groupBy("rel").agg(F.count("*").alias("n")), right.groupBy("rel").agg(F.count("*").alias("m"))
    short = saved(many.join(enough, "rel", "left").filter(F.col("n") > F.coalesce("m", F.lit(0))).select("rel"), "short")
    error = F.raise_error(F.concat(F.lit("no line is left for an entry of relation "), "rel")).cast(dict(right.dtypes)["rule_id"])
    done = done.unionByName(left.join(short, "rel", "left_semi").select("rel", "local_idx", error.alias("rule_id")))
    entries = saved(left.join(unmatched, "rel", "left_semi").join(short, "rel", "left_anti"), "entries")
    lines = saved(right.join(unmatched, "rel", "left_semi").withColumn("place", F.row_number().over(places) - 1), "lines")
    while entries.take(1):
        given = saved(_round(entries, lines), "given")
        done = done.unionByName(given.select("rel", "local_idx", "rule_id"))
        entries = saved(entries.join(given, ["rel", "local_idx"], "left_anti"), "entries")
        lines = saved(lines.join(given, ["rel", "rule_id"], "left_anti"), "lines")
    return done


def _round(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """``rel, local_idx, rule_id``: what the open entries get that nothing before them can dispute.

    An entry is loose if its text has fewer free lines than entries up to it.  Before a relation's first
    loose entry only a text's own entries compete for its lines: those before the text's first one
    without a full signature of its own get theirs, and that one, if it is the text's first, gets the first
    line of the text.  Loose entries at the beginning of a relation get their positions, up to the first whose
    position is not free; that one, if it is the relation's first, gets the first free line.
    """
    rank = lambda name, order: F.row_number().over(Window.partitionBy("rel", name).orderBy(order))
    texts = lines.groupBy("rel", "rule").agg(F.count("*").alias("_lines"), F.min("rule_id").alias("_first_of_text"))
    fulls = lines.withColumn("_nth", rank("full", "rule_id")).select("rel", "full", "_nth", F.col("rule_id").alias("_own"))
    at = lines.select("rel", F.col("place").alias("local_idx"), F.col("rule_id").alias("_at_place"))
    bids = entries.withColumns({"_nth": rank("full", "local_idx"), "_of_text": rank("rule", "local_idx")})
    bids = bids.join(texts, ["rel", "rule"], "left").join(fulls, ["rel", "full", "_nth"], "left").join(at, ["rel", "local_idx"], "left")
    bids = saved(bids.withColumn("_loose", F.col("_of_text") > F.coalesce("_lines", F.lit(0))), "bids")
    at_least = lambda when: F.min(F.when(when, F.col("local_idx")))
    by_rel = bids.groupBy("rel").agg(F.min("local_idx").alias("_head"), at_least(F.col("_loose")).alias("_first_loose"), at_least(~F.col("_loose")).alias("_first_tight"))
    by_text = bids.groupBy("rel", "rule").agg(at_least(F.col("_own").isNull()).alias("_first_other"))
    by_rest = lines.groupBy("rel").agg(F.min("rule_id").alias("_rest"))
    before = lambda end: end.isNull() | (F.col("local_idx") < end)
    bids = bids.join(by_rel, "rel").join(by_text, ["rel", "rule"]).join(by_rest, "rel")
    begin = F.col("_loose") & before(F.col("_first_tight"))
    stuck = bids.filter(begin & F.col("_at_place").isNull()).groupBy("rel").agg(F.min("local_idx").alias("_stuck"))
    bids = bids.join(stuck, "rel", "left")
    tight = ~F.col("_loose") & before(F.col("_first_loose"))
    got = (
        F.when(tight & before(F.col("_first_other")), F.col("_own"))
        .when(tight & (F.col("_of_text") == 1), F.col("_first_of_text"))
        .when(begin & before(F.col("_stuck")), F.col("_at_place"))
        .when(begin & (F.col("local_idx") == F.col("_head")), F.col("_rest"))
    )
    return bids.withColumn("rule_id", got).filter("rule_id is not null").select("rel", "local_idx", "rule_id")


def by_position(index: DataFrame, rules: DataFrame) -> DataFrame:
    """``rel, local_idx, rule_id``: the entry at a position takes the rule at the same position of its relation, null beyond."""
    at = F.row_number().over(Window.partitionBy("rel").orderBy("rule_id")) - 1
    listed = signatures(rules).select("rel", "rule_id").withColumn("local_idx", at)
    return index.select("rel", "local_idx").join(listed, ["rel", "local_idx"], "left")


def strictly_indexed(index: DataFrame) -> DataFrame:
    """The index with ``global_idx`` from 0 over all relations in order; an error unless each relation's local ids are 0, 1, 2 and so on."""
    from .graph import numbered

    at = F.row_number().over(Window.partitionBy("rel").orderBy("local_idx")) - 1
    good = F.when(F.col("local_idx") == at, F.col("local_idx")).otherwise(F.raise_error(F.concat(F.lit("local ids are not in order in relation "), "rel")).cast("int"))
    return numbered(index.withColumn("local_idx", good), [F.col("rel"), F.col("local_idx")], "global_idx")
