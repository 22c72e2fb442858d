"""Readers and writers of the text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import saved

_RULES = T.ArrayType(T.IntegerType())
APPLIED = T.MapType(T.StringType(), T.MapType(T.StringType(), T.MapType(T.StringType(), T.MapType(T.StringType(), _RULES))))
SIDE = T.StructType([T.StructField("candidates", T.ArrayType(T.StringType())), T.StructField("rules", T.ArrayType(_RULES))])
EXPLANATION = T.MapType(T.StringType(), T.StructType([T.StructField("heads", SIDE), T.StructField("tails", SIDE)]))


def triples(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """``s, p, o`` of lines with three fields, split by tabs, else by white space; other lines are dropped, or with ``strict`` an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    tabs = F.split(F.rtrim("value"), "\t")
    f = F.when(F.size(tabs) == 3, tabs).otherwise(F.split(F.trim("value"), r"\s+"))
    rows = lines.select(f.alias("f"))
    if strict:
        bad = F.raise_error(F.concat(F.lit("not three fields: "), F.array_join("f", " ")))
        return rows.select(*[F.when(F.size("f") == 3, F.col("f")[n]).otherwise(bad.cast("string")).alias(c) for n, c in enumerate("spo")])
    return rows.filter(F.size("f") == 3).select(*[F.col("f")[n].alias(c) for n, c in enumerate("spo")])


def numbered_lines(spark: SparkSession, path: str, blank: bool = True, name: str | None = None) -> DataFrame:
    """``file, line, value``: the lines of text files with their numbers from 1, blank ones left out and not counted unless ``blank``.

    Files are split among tasks; each split's lines are counted and the counts of the splits
    before it in the file are added, so no file is read as one value.
    """
    reader = spark.read if name is None else spark.read.option("pathGlobFilter", name)
    lines = reader.text(path)
    others = [c for c in lines.columns if c != "value"]
    lines = lines.select("value", *others, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    if not blank:
        lines = lines.filter(F.trim("value") != "")
    lines = lines.withColumn("_id", F.monotonically_increasing_id())
    blocks = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))  # a row for each split
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return lines.join(blocks, ["file", "_block"]).select("file", (F.col("_base") + F.col("_id") - F.col("_first") + 1).alias("line"), "value", *others)


def ids(spark: SparkSession, path: str) -> DataFrame:
    """``id, token`` of an id map: blank lines are skipped, the rest is cut at the first tab."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    cut = F.split("value", "\t", 2)
    return lines.select(cut[0].cast("int").alias("id"), cut[1].alias("token"))


def mapping(spark: SparkSession, path: str) -> DataFrame:
    """``id, token`` of lines with two fields between blanks; other lines are dropped."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(f.alias("f")).filter(F.size("f") == 2).select(F.col("f")[0].alias("id"), F.col("f")[1].alias("token"))


def unescaped(triples: DataFrame) -> DataFrame:
    """``s, p, o`` with HTML character references replaced by their characters."""

    @F.arrow_udf("string")
    def plain(column):
        import html

        import pyarrow as pa

        return pa.array([None if x is None else html.unescape(x) for x in column.to_pylist()], pa.string())

    return triples.select(*[plain(F.col(c)).alias(c) for c in "spo"])


def permuted(triples: DataFrame, order: str = "spo") -> DataFrame:
    """``s, p, o`` of triples whose three columns came in another order, such as ``sop``."""
    if sorted(order) != sorted("spo"):
        raise ValueError(f"not an order of s, p and o: {order!r}")
    return triples.toDF(*order).select("s", "p", "o")


def write_triples(rows: DataFrame, path: str) -> None:
    """Triples as lines of three fields between tabs."""
    rows.select(F.concat_ws("\t", "s", "p", "o").alias("value")).write.text(path)


def write_splits(splits: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table of :func:`kgloom.operators.graph.split_parts` as triples under ``path``, and beside them ``dataset.json``: ``split, file, triples, entities, relations``."""
    splits = {name: saved(rows, name) for name, rows in splits.items()}  # written as lines and counted
    for name, rows in splits.items():
        write_triples(rows, f"{path}/{name}")
    counts = dataset_counts(splits).withColumn("file", F.col("split"))
    counts.select("split", "file", "triples", "entities", "relations").coalesce(1).write.json(f"{path}/dataset.json")  # a row for each split
    return counts


def write_ids(dictionary: DataFrame, path: str) -> None:
    """An id map as lines of id and token, in the order of the ids over the part files."""
    dictionary.select("id", "token").orderBy("id").select(F.concat_ws("\t", F.col("id").cast("string"), "token").alias("value")).write.text(path)


def rule_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value`` of rule files, for :func:`kgloom.operators.rules.from_lines`."""
    return numbered_lines(spark, path)


def write_rules(rules: DataFrame, path: str) -> None:
    """Rules as lines of counts, confidence and text; with them goes nothing of their ids, as a line's number is its id."""
    rules.select(F.concat_ws("\t", "num_preds", "num_true", "conf", "rule").alias("value")).write.text(path)


def flattened(texts: DataFrame, column: str = "value") -> DataFrame:
    """Applied rules ``direction, p, q, cand, rule_ids`` of nested JSON texts."""
    out = texts.select(F.explode(F.from_json(column, APPLIED)).alias("direction", "a"))
    out = out.select("direction", F.explode("a").alias("p", "b"))
    out = out.select("direction", "p", F.explode("b").alias("q", "c"))
    return out.select("direction", "p", "q", F.explode("c").alias("cand", "rule_ids"))


def nested(applied: DataFrame) -> DataFrame:
    """``direction, p, q, json``: the JSON text of each query of an applied-rules table, which :func:`flattened` reads back.

    A text holds the candidates of one query within its direction and relation, so none grows with the table.
    """
    by = applied.groupBy("direction", "p", "q").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("cand").cast("string").alias("cand"), "rule_ids")))).alias("m"))
    return by.select("direction", "p", "q", F.to_json(F.create_map("direction", F.create_map("p", F.create_map(F.col("q").cast("string"), "m")))).alias("json"))


def write_applied(applied: DataFrame, path: str) -> None:
    """An applied-rules table as JSON, a query a line."""
    nested(applied).select(F.col("json").alias("value")).write.text(path)


def explained(targets: DataFrame, ranking: DataFrame, applied: DataFrame, most: int = 0) -> DataFrame:
    """``s, p, o, value``: an explanation record for each target triple, with both directions, which :func:`explanations` reads back.

    ``ranking``: ``direction, p, q, cand, score``; ``applied``: ``direction, p, q, cand, rule_ids``, of which
    the first ``most`` count (all if 0), and only those with ids from 1 on.  Candidates stand by falling score, ties by their value.
    """
    listed = F.filter(F.coalesce("rule_ids", F.expr("cast(array() as array<int>)")), lambda x: x > 0)
    rows = ranking.select("direction", "p", "q", "cand", "score").join(applied.select("direction", "p", "q", "cand", "rule_ids"), ["direction", "p", "q", "cand"], "left").select("direction", "p", "q", F.struct((-F.col("score")).alias("at"), "cand", (F.slice(listed, 1, most) if most else listed).alias("rules")).alias("x"))
    sides = rows.groupBy("direction", "p", F.col("q").cast("string").alias("q")).agg(F.sort_array(F.collect_list("x")).alias("x"))
    sides = sides.select("direction", "p", "q", F.struct(F.col("x.cand").cast("array<string>").alias("candidates"), F.col("x.rules").alias("rules")).alias("side"))
    empty = F.struct(F.expr("cast(array() as array<string>)").alias("candidates"), F.expr("cast(array() as array<array<int>>)").alias("rules"))
    out = targets.select("s", "p", "o")
    for direction, end in (("head", "o"), ("tail", "s")):
        one = sides.filter(F.col("direction") == direction).select("p", F.col("q").alias(end), F.col("side").alias(f"{direction}s"))
        out = out.join(one, ["p", end], "left").withColumn(f"{direction}s", F.coalesce(f"{direction}s", empty))
    record = F.to_json(F.create_map(F.concat_ws(" ", "s", "p", "o"), F.struct("heads", "tails")))
    return out.select("s", "p", "o", F.concat(record, F.lit(",")).alias("value"))


def explanations(records: DataFrame, column: str = "value") -> DataFrame:
    """``direction, s, p, o, cand, rule_ids, pos`` of explanation records."""
    body = F.regexp_replace(F.trim(column), r",\s*$", "")
    row = records.select(F.explode(F.from_json(body, EXPLANATION, {"allowSingleQuotes": "true"})).alias("key", "v"))
    parts = F.split("key", " ")
    row = row.select(parts[0].alias("s"), parts[1].alias("p"), parts[2].alias("o"), F.explode(F.array(F.struct(F.lit("head").alias("direction"), F.col("v.heads").alias("e")), F.struct(F.lit("tail").alias("direction"), F.col("v.tails").alias("e")))).alias("x"))
    return row.select("x.direction", "s", "p", "o", F.posexplode(F.arrays_zip("x.e.candidates", "x.e.rules")).alias("pos", "z")).select("direction", "s", "p", "o", F.col("z.candidates").alias("cand"), F.col("z.rules").alias("rule_ids"), "pos")


def rule_index(texts: DataFrame, column: str = "value") -> DataFrame:
    """``rel, local_idx, num_preds, num_true, rule`` of ``>>>relation`` blocks."""
    blocks = texts.select(F.explode(F.filter(F.split(column, ">>>"), lambda b: F.trim(b) != "")).alias("b"))
    lines = blocks.select(F.trim(F.substring_index("b", "\n", 1)).alias("rel"), F.explode(F.filter(F.split("b", "\n"), lambda x: F.size(F.split(x, "\t")) >= 5)).alias("line"))
    f = F.split("line", "\t")
    return lines.select("rel", f[0].cast("int").alias("local_idx"), f[1].cast("long").alias("num_preds"), f[2].cast("long").alias("num_true"), f[4].alias("rule"))


def _pieces(spark: SparkSession, path: str, name: str, separator: str | None = None) -> DataFrame:
    """``file, block, at, value``: the pieces of text files between separators, with their splits and their order in a split."""
    reader = spark.read.option("pathGlobFilter", name)
    rows = (reader if separator is None else reader.option("lineSep", separator)).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def _before(rows: DataFrame, amounts: dict[str, str]) -> DataFrame:
    """``rows`` with, for each amount, its sum over all rows before in the file: within a block, and over the blocks before."""
    order = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("file", "block").agg(*[F.sum(a).alias(a) for a in amounts]).select("file", "block", *[F.coalesce(F.sum(a).over(blocks), F.lit(0)).alias(f"_{a}") for a in amounts])  # a row a block
    return rows.join(bases, ["file", "block"]).withColumns({out: F.coalesce(F.sum(a).over(order), F.lit(0)) + F.col(f"_{a}") for a, out in amounts.items()}).drop(*[f"_{a}" for a in amounts])


def _carried(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with each of the columns filled with its last value that is not null so far in the file, over blocks as in :func:`_before`."""
    order = Window.partitionBy("file", "block").orderBy("at")
    blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("file", "block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in names])  # a row a block
    ends = ends.select("file", "block", *[F.last(c, ignorenulls=True).over(blocks).alias(f"_{c}") for c in names])
    return rows.join(ends, ["file", "block"]).withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(order), F.col(f"_{c}")) for c in names}).drop(*[f"_{c}" for c in names])


def rule_index_files(spark: SparkSession, path: str, name: str = "*") -> DataFrame:
    """The rows of :func:`rule_index` from files that are split among tasks, with their ``file``.

    A split's lines belong to the last ``>>>relation`` line in it or in the splits before; only
    each split's last one is carried on.
    """
    rows = _pieces(spark, path, name)
    head = F.when(F.col("value").startswith(">>>"), F.trim(F.substring("value", 4, 2**31 - 1)))
    rows = _carried(rows.withColumn("rel", head), ["rel"]).filter("not startswith(value, '>>>') and rel <> ''")
    f = F.split("value", "\t")
    lines = rows.select("file", "rel", f.alias("f")).filter(F.size("f") >= 5)
    field = lambda n: F.trim(F.get("f", F.lit(n)))
    return lines.select("file", "rel", field(0).cast("int").alias("local_idx"), field(1).cast("long").alias("num_preds"), field(2).cast("long").alias("num_true"), field(4).alias("rule"))


#: Queries of a block in the order of a file of applied rules.
QUERIES_A_BLOCK = 50_000


def applied_files(spark: SparkSession, path: str, name: str = "*") -> DataFrame:
    """The rows of :func:`flattened` from files of one nested JSON object each, ``direction: relation: query: candidate: rule ids``, with their ``file``.

    A file is read in pieces that end with a closing brace, split among tasks.  Sums over the pieces before tell
    whether a piece begins in a string and how deep it stands; so the object is cut where the object of each
    query ends, and only names of directions and relations are carried from piece to piece.  Names may
    hold braces and escaped characters.
    """
    rows = _pieces(spark, path, name, "}")
    plain = F.regexp_replace("value", r"\\.", "")
    count = lambda text, c: F.length(text) - F.length(F.translate(text, c, ""))
    rows = _before(rows.withColumn("quotes", count(plain, '"')), {"quotes": "open_quotes"})
    inside = F.col("open_quotes") % 2
    outside = F.regexp_replace(F.concat(F.when(inside == 1, '"').otherwise(""), plain), r'"[^"]*("|$)', "")
    closes = 1 - (F.col("open_quotes") + F.col("quotes")) % 2
    rows = _before(rows.select("file", "block", "at", "value", count(outside, "{").alias("opens"), closes.alias("closes")), {"closes": "number"})
    # a brace in a string has cut an object's text; its pieces have one number
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "block", "value"))), lambda x: x["value"]), "}")
    objects = rows.groupBy("file", "number").agg(parts.alias("text"), F.sum("opens").alias("opens"))
    objects = objects.withColumns({"block": F.floor(F.col("number") / QUERIES_A_BLOCK), "at": F.col("number")})
    objects = _before(objects, {"opens": "all_opens"}).withColumn("depth", F.col("all_opens") - F.col("number"))
    names = F.regexp_extract_all("text", F.lit(r'"((?:[^"\\]|\\.)*)"\s*:\s*\{'), F.lit(1))
    objects = objects.withColumns({"names": names, "first": F.greatest(F.col("depth") + 1, F.lit(2))})  # the object itself, at depth 1, has no name
    at = lambda level: F.get("names", (F.lit(level) - F.col("first")).cast("int"))
    objects = _carried(objects.withColumns({"direction": at(2), "p": at(3), "q": at(4)}), ["direction", "p"])
    body = F.concat(F.regexp_replace("text", r'(?s)^.*"(?:[^"\\]|\\.)*"\s*:\s*\{', "{"), F.lit("}"))
    rows = objects.filter("q is not null").select("file", *[_unescaped_json(c) for c in ("direction", "p", "q")], F.explode(F.from_json(body, "map<string,array<int>>")).alias("cand", "rule_ids"))
    return rows


def _unescaped_json(name: str):
    """The text that a JSON string stands for."""
    return F.from_json(F.concat(F.lit('{"x":"'), F.col(name), F.lit('"}')), "x string")["x"].alias(name)


def rankings(spark: SparkSession, path: str, top: int = 100, name: str = "*") -> DataFrame:
    """``file, s, p, o, direction, pos, cand, conf`` of the ranking files whose name fits ``name``.

    A record is a triple and its lines ``Heads:`` and ``Tails:`` of candidates and
    confidences in turn; the first ``top`` candidates count, and blank lines do not.
    The lines of a record meet by its number in the file; each goes its way but for the triple.
    """
    lines = numbered_lines(spark, path, blank=False, name=name)
    record, at = F.floor((F.col("line") - 1) / 3), (F.col("line") - 1) % 3
    rows = lines.select("file", record.alias("n"), at.cast("int").alias("at"), "value")
    sides = rows.groupBy("file", "n").agg(*[F.max(F.when(F.col("at") == k, F.col("value"))).alias(c) for k, c in enumerate(("triple", "heads", "tails"))]).dropna()
    triple = F.split(F.trim("triple"), r"\s+")

    def side(direction, label):
        fields = F.split(F.trim(F.regexp_replace(F.col(label.lower()), f"^{label}:", "")), r"\s+")
        return F.struct(F.lit(direction).alias("direction"), fields.alias("fields"))

    sides = sides.select("file", *[triple[k].alias(c) for k, c in enumerate("spo")], F.explode(F.array(side("head", "Heads"), side("tail", "Tails"))).alias("x"))
    sides = sides.select("file", "s", "p", "o", "x.direction", "x.fields").withColumn("many", F.least(F.floor(F.size("fields") / 2).cast("int"), F.lit(top))).filter("many > 0")
    ranked = sides.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    return ranked.select("file", "s", "p", "o", "direction", "pos", F.col("fields")[2 * F.col("pos")].alias("cand"), F.col("fields")[2 * F.col("pos") + 1].cast("double").alias("conf"))


def ranking_records(targets: DataFrame, ranked: DataFrame) -> DataFrame:
    """``s, p, o, value``: the three lines of each target's record, from ``direction, s, p, o, pos, cand, conf``."""
    sides = ranked.groupBy("s", "p", "o", "direction").agg(F.sort_array(F.collect_list(F.struct("pos", "cand", "conf"))).alias("xs"))
    sides = sides.select("s", "p", "o", "direction", F.array_join(F.transform("xs", lambda x: F.concat(x["cand"].cast("string"), F.lit("\t"), x["conf"].cast("string"), F.lit("\t"))), "").alias("text"))
    both = sides.groupBy("s", "p", "o").agg(*[F.max(F.when(F.col("direction") == d, F.col("text"))).alias(d) for d in ("head", "tail")])
    lines = [F.concat_ws(" ", "s", "p", "o"), F.concat(F.lit("Heads: "), F.coalesce("head", F.lit(""))), F.concat(F.lit("Tails: "), F.coalesce("tail", F.lit("")))]
    return targets.select("s", "p", "o").join(both, ["s", "p", "o"], "left").select("s", "p", "o", F.concat_ws("\n", *lines).alias("value"))


def metric_files(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each ``metric-*.json`` of a folder, with its path as ``file``."""
    return spark.read.json(folder, multiLine=True, pathGlobFilter="metric-*.json").withColumn("file", F.input_file_name())


def write_weights(fitted: DataFrame, hits: DataFrame, path: str) -> None:
    """Weights ``ruleID, original, trained, train_hit_count`` as CSV by relation; weights have seven digits."""
    rows = fitted.join(hits.select("p", "rule_id", "train_hit_count"), ["p", "rule_id"], "left")
    rows = rows.select("p", F.col("rule_id").alias("ruleID"), F.round("original", 7).alias("original"), F.round("trained", 7).alias("trained"), F.coalesce("train_hit_count", F.lit(0).cast("long")).alias("train_hit_count"))
    rows.repartition("p").sortWithinPartitions("p", "ruleID").write.partitionBy("p").csv(path, header=True)


def dataset_counts(splits: dict[str, DataFrame]) -> DataFrame:
    """``split, triples, entities, relations`` of tables ``s, p, o``, and of all together as ``all``."""
    rows = None
    for name, df in splits.items():
        part = df.select(F.lit(name).alias("split"), "s", "p", "o")
        rows = part if rows is None else rows.unionByName(part)
    each_and_all = F.explode(F.array("split", F.lit("all"))).alias("split")

    def different(values: DataFrame, name: str) -> DataFrame:
        """How many different ``x`` each split has and all have; only different ones of a split are copied for all."""
        return values.distinct().select(each_and_all, "x").distinct().groupBy("split").agg(F.count("x").alias(name))

    triples = rows.groupBy("split").agg(F.count("*").alias("n")).select(each_and_all, "n").groupBy("split").agg(F.sum("n").alias("triples"))
    relations, entities = different(rows.select("split", F.col("p").alias("x")), "relations"), different(rows.select("split", F.explode(F.array("s", "o")).alias("x")), "entities")
    return triples.join(relations, "split").join(entities, "split").select("split", "triples", "entities", "relations")


def write_by_relation(rows: DataFrame, path: str, relation: str = "p") -> None:
    """A table as Parquet in a folder for each relation; a relation of any size is written by many tasks."""
    rows.write.partitionBy(relation).parquet(path)


def write_synergy(fitted: DataFrame, hits: DataFrame, path: str) -> None:
    """Pair weights ``rule1ID, rule2ID, original, trained, train_hit_count`` as CSV by relation; relations without a pair have no file."""
    rows = fitted.join(hits.select("p", "a", "b", "train_hit_count"), ["p", "a", "b"], "left")
    rows = rows.select("p", F.col("a").alias("rule1ID"), F.col("b").alias("rule2ID"), F.round("original", 7).alias("original"), F.round("trained", 7).alias("trained"), F.coalesce("train_hit_count", F.lit(0).cast("long")).alias("train_hit_count"))
    rows.write.partitionBy("p").csv(path, header=True)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A JSON line for each relation, its fields as the columns of ``metrics`` (nested ones as structs), in ``metric-*.json`` folders by relation."""
    metrics.select("p", F.to_json(F.struct(*metrics.columns)).alias("value")).withColumn("name", F.concat(F.lit("metric-"), F.col("p").cast("string"))).drop("p").write.partitionBy("name").text(path)


def write_report(counts: DataFrame, rows: DataFrame, path: str) -> None:
    """A comparison report of :mod:`kgloom.operators.compare`: its counts as one JSON row, and a JSON line for each difference by section."""
    counts.coalesce(1).write.json(f"{path}/counts")  # one row
    rows.write.partitionBy("section").json(f"{path}/differences")


def write_config(spark: SparkSession, config: dict, path: str) -> None:
    """The options of a run as one JSON object beside its output."""
    import json

    spark.createDataFrame([(json.dumps(config, sort_keys=True, default=str),)], "value string").coalesce(1).write.text(path)


def write_removed(removed: DataFrame, path: str) -> None:
    """The removed rules' texts, a line each."""
    removed.select(F.col("rule").alias("value")).write.text(path)


def schedule(text: str, kind: type = float) -> tuple:
    """The values of a comma-separated schedule; an empty one, and a value that is not of its kind, are errors."""
    parts = [x.strip() for x in str(text).split(",") if x.strip()]
    if not parts:
        raise ValueError("the schedule is empty")
    try:
        return tuple(kind(x) for x in parts)
    except ValueError as e:
        raise ValueError(f"not a schedule of {kind.__name__}: {text!r}") from e
