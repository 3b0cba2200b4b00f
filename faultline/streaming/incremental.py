"""History metrics over a stream of file changes.

Every micro-batch runs the same batch operators on its own rows and adds what earlier batches left
behind. The state is a set of per-key sums in a bucketed table: a batch reads the buckets its own files and authors
fall into, writes them anew, and lists them in the state's next version. Version e is the state before batch e, so a
batch that is run again overwrites its own output and version and counts nothing twice. A hot file or author is spread over
tasks as in the batch form.

Rows inside a batch may come in any order. A row that is older than what earlier batches brought for its file or its author
would change values that are written already; such late rows are set apart in a table of their own and counted nowhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline.operators.history import WHEN
from faultline.operators.scan import ordered_scan, previous, row_number
from faultline.session import cut_lineage
from faultline.sinks.buckets import BucketTable

STATE_SCHEMA = "kind string, key string, n bigint, last timestamp_ntz"
STATE_KEYS = ["kind", "key"]


def _increments(batch: DataFrame) -> DataFrame:
    """What a batch adds per file and per author: number of rows and the latest date."""
    parts = F.array(
        F.struct(F.lit("path").alias("kind"), F.col("path").alias("key")),
        F.struct(F.lit("author").alias("kind"), F.col("author").cast("string").alias("key")),
    )
    return (
        batch.select("commit_date", F.inline(parts))
        .groupBy("kind", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.max("commit_date").alias("last"))
    )


def state_table(spark: SparkSession, state_path: str, buckets: int = 64) -> BucketTable:
    """The state at ``state_path``, made empty if it is not there."""
    table = BucketTable(spark, state_path)
    return table if table.versions() else BucketTable.create(spark.createDataFrame([], STATE_SCHEMA), state_path, STATE_KEYS, buckets)


def _added(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy(*STATE_KEYS).agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def history_batch(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Changes of the file so far, date of the change before, touches of the author so far."""
    run = ordered_scan(batch, ["path"], WHEN, {"_n": row_number(), "_prev": previous("commit_date")})
    run = ordered_scan(run, ["author"], WHEN, {"_mine": row_number()})
    files = known.filter("kind = 'path'").select(F.col("key").alias("path"), F.col("n").alias("_fn"), F.col("last").alias("_fl"))
    authors = known.filter("kind = 'author'").select(F.col("key").alias("_a"), F.col("n").alias("_an"))
    joined = run.withColumn("_a", F.col("author").cast("string")).join(files, "path", "left").join(authors, "_a", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        *batch.columns,
        (F.col("_n") + F.coalesce("_fn", zero)).alias("file_changes"),
        F.coalesce("_prev", "_fl").alias("prev_date"),
        (F.col("_mine") + F.coalesce("_an", zero)).alias("exp"),
    )


def marked_late(batch: DataFrame, known: DataFrame) -> DataFrame:
    """``batch`` with ``late``: the row is before the latest date known of its file or of its author."""
    files = known.filter("kind = 'path'").select(F.col("key").alias("_p"), F.col("last").alias("_fl"))
    authors = known.filter("kind = 'author'").select(F.col("key").alias("_a"), F.col("last").alias("_al"))
    both = batch.join(files, F.col("path") == F.col("_p"), "left").join(authors, F.col("author").cast("string") == F.col("_a"), "left")
    late = F.col("commit_date") < F.greatest("_fl", "_al")
    return both.select(*batch.columns, F.coalesce(late, F.lit(False)).alias("late"))


def late_rows(out_path: str) -> str:
    """Where the late rows of a stream stand."""
    return f"{out_path.rstrip('/')}-late"


def history_writer(out_path: str, state_path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``. The state must be that of the stream's own progress: batch e needs version e."""

    def write(batch: DataFrame, epoch: int) -> None:
        state = state_table(batch.sparkSession, state_path, buckets)
        rows = cut_lineage(batch)
        known = cut_lineage(state.near(_increments(rows), epoch))
        marked = cut_lineage(marked_late(rows, known))
        timely = marked.filter(~F.col("late")).drop("late")
        history_batch(timely, known).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
        marked.filter("late").drop("late").write.mode("overwrite").parquet(f"{late_rows(out_path)}/epoch={epoch}")
        state.apply(_increments(timely), _added, epoch)
        state.forget(2)  # this batch's state and the one before, should the batch be run again

    return write


def start_history_stream(changes: DataFrame, out_path: str, state_path: str, progress_path: str) -> StreamingQuery:
    """Process what is there and stop. ``changes`` is a streaming frame of (commit_id, commit_date,
    path, author); call again with the same paths to go on."""
    return (
        changes.writeStream.foreachBatch(history_writer(out_path, state_path))
        .option("checkpointLocation", progress_path)
        .trigger(availableNow=True)
        .start()
    )

