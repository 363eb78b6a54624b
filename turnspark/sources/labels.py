"""Label files: writing, reading back with row positions, and auditing many at once."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote, urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnspark.lineage import cut_lineage

HEADER = "id,label"  # fixed value: the exact first line of a label file


def write_labels(
    df: DataFrame, path: str, order: str = "pos", single_file: bool = False
) -> None:
    """Write id,label in row order as CSV parts: part names sort like the rows.

    ``single_file`` writes one part through one task; it is meant for small tables that are
    handed over as one file.
    """
    ordered = df.orderBy(order)
    if single_file:
        ordered = df.coalesce(1).sortWithinPartitions(order)
    ordered = ordered.select("id", "label")
    ordered.write.mode("overwrite").option("header", True).csv(path)


def read_label_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All label tables below one or more paths as rows (file, bytes, pos, id, label, header_ok).

    A file named ``part-*`` belongs to the table that its folder is; any other file is a table of
    its own. ``file`` names the table, ``bytes`` is the size of the row's file and ``is_first``
    marks the first line of each file. Positions run over the parts in the order of their names.
    Lines are numbered per file split first and shifted by the splits before, so neither a
    large file nor a table of many parts has to be read by one task. Malformed lines stay, with null
    id or label.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_line"),
        "value",
    )
    stable = cut_lineage(lines)
    splits = stable.groupBy("_path", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("_line").alias("_first")
    )
    splits = splits.withColumn("file", F.regexp_replace("_path", "/part-[^/]*$", ""))
    ordered = W.partitionBy("file").orderBy("_path", "block")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    starts = splits.select(
        "file",
        "_path",
        "block",
        "_first",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"),
        F.dense_rank().over(W.partitionBy("file").orderBy("_path")).alias("_headers"),
        (F.row_number().over(W.partitionBy("_path").orderBy("block")) == 1).alias("_opens"),
    )
    rows = stable.join(starts, ["_path", "block"])
    cells = F.split("value", ",")
    two = F.size(cells) == 2
    is_first = F.col("_opens") & (F.col("_line") == F.col("_first"))
    return rows.select(
        "file",
        "bytes",
        (F.col("_shift") + F.col("_line") - F.col("_first") - F.col("_headers")).alias("pos"),
        F.when(two, F.trim(F.get(cells, 0))).alias("id"),
        F.when(two, F.nullif(F.trim(F.get(cells, 1)), F.lit(""))).alias("label"),
        (is_first & (F.trim("value") == HEADER)).alias("header_ok"),
        is_first.alias("is_first"),
    )


def audit_labels(
    spark: SparkSession, path: str, expected: DataFrame, domain: Sequence[int]
) -> DataFrame:
    """Status of every label table: violations per rule and class counts, no file aborts the run.

    ``expected`` has pos and id (as text). A table is one file or a folder of parts, each part with
    its header. One pass over all files together.
    """
    rows = read_label_files(spark, path)
    body = rows.where("not is_first")
    want_n = expected.agg(F.count(F.lit(1))).scalar()
    per_id = body.groupBy("file", "id").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos")
    )
    joined = per_id.join(
        expected.select(F.col("id").cast("string").alias("id"), F.col("pos").alias("want")),
        "id",
        "left",
    )
    by_id = joined.groupBy("file").agg(
        F.count_if(F.col("want").isNotNull()).alias("_known"),
        F.count_if(F.col("want").isNull()).alias("unexpected_ids"),
        F.count_if(F.col("n") > 1).alias("duplicate_ids"),
        F.count_if(F.col("pos") != F.col("want")).alias("wrong_positions"),
    )
    number = F.expr("try_cast(label AS DOUBLE)")
    valid = number.isin([float(v) for v in domain])
    by_row = rows.groupBy("file").agg(
        F.sum(F.when(F.col("is_first"), F.col("bytes"))).alias("bytes"),
        F.count_if(~F.col("is_first")).alias("n_rows"),
        F.min(F.when(F.col("is_first"), F.col("header_ok"))).alias("header_ok"),
        F.count_if(~F.col("is_first") & ~F.coalesce(valid, F.lit(False))).alias("bad_labels"),
        *[
            F.count_if(~F.col("is_first") & (number == float(v))).alias(f"class{v}")
            for v in domain
        ],
    )
    audit = by_row.join(by_id, "file", "left").fillna(0)
    audit = audit.withColumn("missing_ids", want_n - F.col("_known")).withColumn(
        "row_count_ok", F.col("n_rows") == want_n
    )
    problems = (
        F.col("unexpected_ids")
        + F.col("duplicate_ids")
        + F.col("wrong_positions")
        + F.col("bad_labels")
        + F.col("missing_ids")
    )
    ok = F.col("header_ok") & F.col("row_count_ok") & (problems == 0)
    return audit.withColumn("status", F.when(ok, "OK").otherwise("INVALID")).drop("_known")


def list_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes of all files below a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"))


def _exists(spark: SparkSession, root: str) -> bool:
    try:
        spark.read.text(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def load_references(spark: SparkSession, roots: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Reference tables (reference, pos, id, label) by name; the first root wins.

    A name is a file or a folder of parts directly below a root. All roots are read in one scan.
    Missing roots and names found in no root simply have no rows. Roots are told apart by their paths.
    """
    found = [root.rstrip("/") for root in roots if _exists(spark, root)]
    if not found:
        return spark.createDataFrame([], "reference string, pos long, id string, label int")
    rows = read_label_files(spark, found)
    root = F.parse_url(F.regexp_replace("file", "/[^/]*$", ""), F.lit("PATH"))
    priority = F.coalesce(
        *[F.when(root == quote(urlsplit(r).path), F.lit(i)) for i, r in enumerate(found)]
    )
    tables = rows.select(
        "*", F.element_at(F.split("file", "/"), -1).alias("reference"), priority.alias("_root")
    ).where(F.col("reference").isin(list(names)) & F.col("_root").isNotNull())
    winners = tables.where("is_first").groupBy("reference").agg(F.min("_root").alias("_root"))
    kept = tables.where("not is_first").join(F.broadcast(winners), ["reference", "_root"])
    return kept.select("reference", "pos", "id", F.expr("try_cast(label AS INT)").alias("label"))
