"""Triples: projection of tables to a graph, dictionaries, encoding and splits.

Tokens are strings, ids dense integers from 0.  Dense numbering sorts once by
range and adds the offsets of the partitions, so no single task sees all tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..store import saved
from .skew import dealt, tasks_of

#: Relation, table, prefix and column of the subject, prefix and column of the object.
PROJECTION = (
    ("in_region", "nation", "n:", "n_nationkey", "r:", "n_regionkey"),
    ("cust_nation", "customer", "c:", "c_custkey", "n:", "c_nationkey"),
    ("supp_nation", "supplier", "s:", "s_suppkey", "n:", "s_nationkey"),
    ("in_segment", "customer", "c:", "c_custkey", "m:", "c_mktsegment"),
    ("ordered_by", "orders", "o:", "o_orderkey", "c:", "o_custkey"),
    ("contains", "lineitem", "o:", "l_orderkey", "p:", "l_partkey"),
    ("shipped_by", "lineitem", "o:", "l_orderkey", "s:", "l_suppkey"),
    ("supplied_by", "lineitem", "p:", "l_partkey", "s:", "l_suppkey"),
    ("has_brand", "part", "p:", "p_partkey", "b:", "p_brand"),
    ("has_type", "part", "p:", "p_partkey", "t:", "p_type"),
)

#: What orders the rows of each relation's table.
ROW_ORDER = (("n_nationkey",), ("c_custkey",), ("s_suppkey",), ("c_custkey",), ("o_orderkey",), *[("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")] * 3, ("p_partkey",), ("p_partkey",))

#: Bits of a row's place in its table: 33 of its number in a partition, 20 of the partition.
PLACES = 53


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def projected(spark: SparkSession, sf_dir: str, relations: tuple[str, ...] | None = None) -> DataFrame:
    """``s, p, o`` of the driver tables as they stand, with repetitions."""
    out = None
    for p, table, sp, s, op, o in PROJECTION:
        if relations and p not in relations:
            continue
        part = read(spark, sf_dir, table).select(F.concat(F.lit(sp), F.col(s).cast("string")).alias("s"), F.lit(p).alias("p"), F.concat(F.lit(op), F.col(o).cast("string")).alias("o"))
        out = part if out is None else out.unionByName(part)
    return out


def project(spark: SparkSession, sf_dir: str, relations: tuple[str, ...] | None = None) -> DataFrame:
    """``s, p, o`` of the driver tables, each once; one shuffle for all relations."""
    return projected(spark, sf_dir, relations).distinct()


def by_subject(triples: DataFrame, tasks: int | None) -> DataFrame:
    """``triples``, each once, dealt by subject, so that joins and groups by subject add no shuffle."""
    return dealt(triples, tasks, "s").distinct()


def in_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``s, p, o, at`` of the tables' rows; the number ``at`` grows with the relation, then with what orders its rows, nulls last.

    A table is sorted by range once for all its relations, and a row's place is its partition and its number there.
    """
    tables: dict = {}
    for n, (relation, keys) in enumerate(zip(PROJECTION, ROW_ORDER, strict=True)):
        tables.setdefault((relation[1], keys), []).append((n, relation))
    out = None
    for (table, keys), relations in tables.items():
        ends = {c for _, (_, _, _, s, _, o) in relations for c in (s, o)}
        rows, order = read(spark, sf_dir, table).select(*dict.fromkeys([*keys, *sorted(ends)])), [F.col(k).asc_nulls_last() for k in keys]
        tasks = tasks_of(rows)
        placed = (rows.repartitionByRange(*order) if tasks is None else rows.repartitionByRange(tasks, *order)).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
        triples = [F.struct(F.concat(F.lit(sp), F.col(s).cast("string")).alias("s"), F.lit(p).alias("p"), F.concat(F.lit(op), F.col(o).cast("string")).alias("o"), (F.lit(n << PLACES) + F.col("_at")).alias("at")) for n, (p, _, sp, s, op, o) in relations]
        part = placed.select(F.explode(F.array(*triples)).alias("x")).select("x.*")
        out = part if out is None else out.unionByName(part)
    return out


def tokens(triples: DataFrame) -> DataFrame:
    """The distinct subjects and objects as ``token``."""
    return triples.select(F.explode(F.array("s", "o")).alias("token")).distinct()


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with a dense number from 0 in the given total order.

    The rows are written as they come, as dealing by range reads them twice; then they are dealt, sorted
    and written once more, so that the partitions whose rows are counted are those whose rows are numbered.
    """
    cut = saved(df, "unnumbered").repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id() % F.lit(2**33)})
    cut = saved(cut, "numbered")
    counts = cut.groupBy("_part").agg(F.count("*").alias("n"))  # a row for each partition
    base = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return cut.join(F.broadcast(base), "_part").withColumn(out, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def sorted_dictionary(triples: DataFrame) -> DataFrame:
    """``id, token`` with ids in the order of the tokens' bytes."""
    return numbered(tokens(triples), [F.col("token")], "id").select("id", "token")


def first_seen(triples: DataFrame) -> DataFrame:
    """``token, at``: where each token is seen first in rows with the number ``at``, subject before object.

    The least of a number is kept by hash where the rows are; a struct's would need a sort of all of them.
    """
    ends = F.array(*[F.struct(F.col(c).alias("token"), (F.col("at") * 2 + side).alias("at")) for side, c in enumerate(("s", "o"))])
    return triples.select(F.explode(ends).alias("x")).select("x.*").groupBy("token").agg(F.min("at").alias("at"))


def first_seen_dictionary(triples: DataFrame) -> DataFrame:
    """``id, token`` by first appearance in rows as of :func:`in_file_order`."""
    return numbered(first_seen(triples), [F.col("at")], "id").select("id", "token")


def encode(triples: DataFrame, entities: DataFrame, relations: DataFrame, strict: bool = False, tasks: int | None = None) -> DataFrame:
    """``s, p, o`` as ids.  Unknown tokens drop the row, or are an error with ``strict``.

    Triples that come from :func:`by_subject` are shuffled once more, by object, into ``tasks`` partitions.
    """
    how = "left" if strict else "inner"
    out = triples
    for column, ids in (("s", entities), ("p", relations), ("o", entities)):
        out = out if column != "o" or tasks is None else dealt(out, tasks, "o")
        out = out.join(ids.select(F.col("token").alias(column), F.col("id").alias(f"_{column}")), column, how)

    def value(column):
        found = F.col(f"_{column}")
        return F.when(found.isNull(), F.raise_error(F.concat(F.lit("unknown token "), F.coalesce(F.col(column), F.lit("null")))).cast("long")).otherwise(found) if strict else found

    return out.select(*[value(c).alias(c) for c in ("s", "p", "o")])


def without_unseen(rows: DataFrame, train: DataFrame) -> DataFrame:
    """The rows whose subject, object and relation all occur in ``train``."""
    ents = tokens(train)
    return rows.join(ents.withColumnRenamed("token", "s"), "s", "left_semi").join(ents.withColumnRenamed("token", "o"), "o", "left_semi").join(train.select("p").distinct(), "p", "left_semi").select("s", "p", "o")


def index(triples: DataFrame, *figures) -> DataFrame:
    """``direction, p, q`` and ``figures``, aggregates over the answers ``a``, of both completion queries of each triple.

    ``triples`` are those of :func:`by_subject`: the tail queries need no shuffle, the head queries one of partial figures.
    """
    sides = [triples.select(F.lit(side).alias("direction"), "p", F.col(q).alias("q"), F.col(a).alias("a")).groupBy("p", "q").agg(*figures).select(F.lit(side).alias("direction"), "*") for side, q, a in (("tail", "s", "o"), ("head", "o", "s"))]
    return sides[0].unionByName(sides[1])


def sizes(triples: DataFrame) -> DataFrame:
    """``p, n, subjects, objects`` of triples as of :func:`by_subject`: how many triples each relation has, and different ends."""
    subjects = triples.groupBy("p", "s").agg(F.count("*").alias("n")).groupBy("p").agg(F.sum("n").alias("n"), F.count("s").alias("subjects"))
    objects = triples.select("p", "o").distinct().groupBy("p").agg(F.count("o").alias("objects"))
    return subjects.join(objects, "p")  # a row for each relation


def answers(triples: DataFrame) -> DataFrame:
    """Both completion queries of each triple: ``direction, p, q, a``."""
    tail = triples.select(F.lit("tail").alias("direction"), "p", F.col("s").alias("q"), F.col("o").alias("a"))
    head = triples.select(F.lit("head").alias("direction"), "p", F.col("o").alias("q"), F.col("s").alias("a"))
    return tail.unionByName(head).distinct()


def relation_counts(test: DataFrame, relations: DataFrame) -> DataFrame:
    """``p, n`` for every relation, 0 where ``test`` has none."""
    counts = test.groupBy("p").agg(F.count("*").alias("n"))
    return relations.join(counts, "p", "left").select("p", F.coalesce("n", F.lit(0)).alias("n"))


def split_parts(splits: dict[str, DataFrame], sample_seed: int = 0) -> dict[str, DataFrame]:
    """The tables of a split writer from ``train``, ``valid`` and ``test`` (``s, p, o``).

    Beside the splits: ``valid_without_unseen`` and ``test_without_unseen``, and
    ``train_sample``, as many rows of train as valid has, drawn by a seeded hash.
    """
    out = dict(splits)
    for name in ("valid", "test"):
        out[f"{name}_without_unseen"] = without_unseen(splits[name], splits["train"])
    out["train_sample"] = sample_of(splits["train"], splits["valid"].count(), sample_seed)
    return out


def sample_of(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the first by a seeded hash of all columns; equal rows are told apart by their place."""
    columns = rows.columns
    drawn = rows.withColumn("_h", F.xxhash64(F.lit(seed), *columns))
    return numbered(drawn, [F.col("_h"), *[F.col(c) for c in columns]], "_n").filter(F.col("_n") < n).select(*columns)
