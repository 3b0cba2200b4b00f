"""The incremental history on the events table."""

from pyspark.sql import functions as F

from faultline.plans.registry import VIEWS, query
from faultline.session import shared_folder
from faultline.streaming.incremental import start_history_stream

VIEWS["v_stream"] = """
SELECT event_id AS commit_id, ts AS commit_date, event_type AS path, user_id AS author FROM {events}"""


@query(
    "q_stream_history",
    """SELECT commit_id, path, author, row_number() OVER f AS file_changes, lag(commit_date) OVER f AS prev_date,
    row_number() OVER (PARTITION BY author ORDER BY commit_date, commit_id) AS exp FROM {v_stream} WINDOW f AS (PARTITION BY path ORDER BY commit_date, commit_id)""",
)
def q_stream_history(t):
    """All events, delivered in three time slices; the stream is stopped and taken up in between."""
    base = shared_folder(t.spark, "history-stream")
    rows = t.v_stream
    schema = rows.schema
    lo, hi = rows.agg(F.min("commit_date"), F.max("commit_date")).first()
    marks = [lo + (hi - lo) * i / 3 for i in range(3)] + [None]
    for i in range(3):
        part = rows.filter(F.col("commit_date") >= F.lit(marks[i]).cast("timestamp_ntz"))
        if marks[i + 1] is not None:
            part = part.filter(F.col("commit_date") < F.lit(marks[i + 1]).cast("timestamp_ntz"))
        part.write.mode("append").parquet(f"{base}/in")
        changes = t.spark.readStream.schema(schema).parquet(f"{base}/in")
        start_history_stream(changes, f"{base}/out", f"{base}/state", f"{base}/progress").awaitTermination()
    out = t.spark.read.parquet(f"{base}/out")
    return out.select("commit_id", "path", "author", "file_changes", "prev_date", "exp")
