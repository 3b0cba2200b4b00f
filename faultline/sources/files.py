"""File and table scans. Schemas are declared, never inferred."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Layouts of the files this library exchanges.
DATASET_SCHEMA = "commit_sha string, commit_date timestamp_ntz, project string, label double, sources string"
SIZES_SCHEMA = "commit_sha string, lines_added bigint, lines_deleted bigint, lines_added_or_deleted bigint"
RESULT_SCHEMA = "commit_sha string, y_true double, y_pred double"
LIFETIME_OPTIONS = {"sep": ";", "quote": "'"}


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str, header: bool = True, sep: str = ",", **options: str) -> DataFrame:
    return spark.read.schema(schema).options(header=header, sep=sep, **options).csv(path if isinstance(path, str) else list(path))


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Labelled commits; labels written as ``1.0`` become 1, sources a list."""
    raw = read_csv(spark, path, DATASET_SCHEMA)
    return raw.withColumn("label", F.col("label").cast("int")).withColumn("sources", F.split("sources", ","))


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_results(
    spark: SparkSession, path: str, schema: str = RESULT_SCHEMA, header: bool = True, sep: str = "\t"
) -> DataFrame:
    """Scored changes; a missing path gives no rows."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_csv(spark, path, schema, header=header, sep=sep)


def tail_fields(lines: DataFrame, column: str = "value") -> DataFrame:
    """The last two of two or more blank-separated fields: truth and score."""
    parts = F.filter(F.split(F.trim(column), r"\s+"), lambda p: p != "")
    return (
        lines.withColumn("_p", parts)
        .filter(F.size("_p") >= 2)
        .withColumn("y_true", F.element_at("_p", -2).try_cast("double").cast("int"))
        .withColumn("y_pred", F.element_at("_p", -1).try_cast("double"))
        .drop("_p")
    )


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of frames that may lack columns; lacking ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_lifetime_files(spark: SparkSession, files: dict[str, Sequence[tuple[str, str]]]) -> DataFrame:
    """Lifetime files (``;`` between, ``'`` around fields) of several projects as one frame.
    ``files`` maps a project to (path, schema) pairs; files without ground truth lack its columns."""
    frames = [
        read_csv(spark, path, schema, **LIFETIME_OPTIONS).withColumn("project", F.lit(project))
        for project, pairs in files.items()
        for path, schema in pairs
    ]
    return union_by_name(frames)


def read_table(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table in ``parts`` ranges of a numeric column. User and password come from the
    session settings ``faultline.jdbc.user`` and ``faultline.jdbc.password``."""
    return (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("user", spark.conf.get("faultline.jdbc.user", ""))
        .option("password", spark.conf.get("faultline.jdbc.password", ""))
        .option("partitionColumn", column)
        .option("lowerBound", low)
        .option("upperBound", high)
        .option("numPartitions", parts)
        .load()
    )


def run_sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """SQL over frames named in braces."""
    return spark.sql(text, **frames)


def date_range(df: DataFrame, column: str, first: str, last: str, *ties: str) -> DataFrame:
    """Rows between two dates (both included), by date; the filter reaches the scan."""
    kept = df.filter(F.col(column).between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))
    return kept.orderBy(column, *ties)


def any_matches(df: DataFrame, array: str, pattern: str) -> DataFrame:
    """Rows where an entry of the array matches, case ignored."""
    return df.filter(F.exists(array, lambda v: v.rlike(f"(?i){pattern}")))


def typed_json(text: Column, schema: str) -> Column:
    """Nested text as a typed value; unreadable text is null."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def zipped_rows(df: DataFrame, **lists: str) -> DataFrame:
    """Parallel lists of a row as one row per position."""
    return df.select(F.inline(F.arrays_zip(*[F.col(c).alias(n) for n, c in lists.items()])))


def ground_truth_pairs(files: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of ground-truth text: two blanks between fields, one header line, lines starting with
    ``#`` or ``%`` left out."""
    lines = files.select(key, F.posexplode(F.split(text, "\n")).alias("_i", "_l"))
    rows = lines.filter((F.col("_i") > 0) & (F.col("_l") != "") & ~F.substring("_l", 1, 1).isin("#", "%"))
    part = F.split(F.regexp_replace("_l", "\r", ""), "  ")
    get = lambda i: F.get(part, F.lit(i))
    return rows.select(key, get(0).alias("vcc"), get(1).alias("fix"), get(2).alias("cve")).filter(F.col("cve").isNotNull())


def from_path(df: DataFrame, **patterns: str) -> DataFrame:
    """Columns read off the path of each row's file."""
    path = F.col("_metadata.file_path")
    return df.select("*", *[F.regexp_extract(path, p, 1).alias(n) for n, p in patterns.items()])


def inverted_map(df: DataFrame, key: str, text: str, missing: str = "None") -> DataFrame:
    """JSON maps ``{cve: [fix, ...]}`` as distinct (fix, cve) rows; the missing mark is dropped."""
    entries = F.from_json(text, "map<string, array<string>>")
    rows = df.select(F.explode(entries).alias("cve", "_f")).select("cve", F.explode("_f").alias("fix"))
    return rows.filter(F.col("fix").isNotNull() & (F.col("fix") != missing)).select("fix", "cve").distinct()
