"""Fixity audit of replicated WARC archives by Merkle trees over ordered offset ranges.

The records of an archive file, in order of offset, are the leaves' content: a leaf covers ``leaf_bytes`` of offsets and
hashes the hashes of the records that begin there; every node above hashes ``fanout`` consecutive children. Two replicas
are compared at the roots; only below roots that differ are children compared, level by level, down to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.llm.sharding import numbered
from faultline.llm.storage import stored

CRLF = "\r\n"


def warc_record(url: Column, payload: Column) -> Column:
    """Text of a WARC response record with its payload; null counts as empty."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: response{CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit(f"{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF), body, F.lit(CRLF + CRLF),
    )


def null_id_files(pages: DataFrame, id_col: str = "page_id", per_file: int = 1000) -> int:
    """How many archives the records with a null id need."""
    return max(1, -(-pages.filter(F.col(id_col).isNull()).count() // per_file))


def record_table(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", per_file: int = 1000,
    null_files: int | None = None,
) -> DataFrame:
    """The records of archives with ``per_file`` ids each: ``file``, ``record_id``, ``offset``, ``length``, ``digest``.
    Records stand in order of id. Null ids go to ``null_files`` files below 0 (as many as ``null_id_files`` says by
    default; replicas that are compared need the same number) by a hash of their content, equal ones in blocks of
    ``per_file``. Repeated rows are records of their own."""
    files = null_id_files(pages, id_col, per_file) if null_files is None else null_files
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    content = F.xxhash64(F.col("url").isNull(), "url", F.col("html").isNull(), "html")
    loose = numbered(slim.filter("id is null").select(content.alias("key"), F.struct("id", "url", "html").alias("rec")))
    block = F.xxhash64("key", F.floor(F.col("nth") / per_file))
    placed = slim.filter("id is not null").select(F.floor(F.col("id") / per_file).cast("long").alias("file"), "id", "url", "html").unionByName(
        loose.select((-1 - F.pmod(block, F.lit(files))).cast("long").alias("file"), "rec.id", "rec.url", "rec.html")
    )
    record = warc_record(F.col("url"), F.col("html"))
    rows = placed.select(
        "file", F.col("id").alias("record_id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"),
    )
    # an archive file holds per_file ids, so the window is bounded by the format
    ahead = Window.partitionBy("file").orderBy(F.col("record_id").asc_nulls_first(), "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long"))


def _children(level_rows: DataFrame, key: str) -> Column:
    """Hash of the children's hashes in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("hash").alias("h"))))
    return F.sha2(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["k"].cast("string"), x["h"])), "|"), 256)


def merkle_tree(records: DataFrame, leaf_bytes: int = 1 << 18, fanout: int = 16, levels: int = 4) -> list[DataFrame]:
    """Levels of the trees of all files, leaves first, roots last: ``file``, ``node``, ``hash``. A node of level k covers
    ``leaf_bytes * fanout ** k`` of offsets; the root covers all of the file."""
    leaves = stored(
        records.select(
            "file", F.floor(F.col("offset") / leaf_bytes).alias("node"), "offset",
            F.concat_ws(",", "digest", F.col("length").cast("string"), F.coalesce(F.col("record_id").cast("string"), F.lit("-"))).alias("hash"),
        ).groupBy("file", "node").agg(_children(records, "offset").alias("hash")),
        "merkle",
    )
    tree = [leaves]
    for level in range(1, levels + 1):
        up = F.lit(0).cast("long") if level == levels else F.floor(F.col("node") / fanout)
        below = tree[-1]
        tree.append(below.withColumn("up", up).groupBy("file", "up").agg(_children(below, "node").alias("hash")).withColumnRenamed("up", "node"))
    return tree


def audit(left: DataFrame, right: DataFrame, leaf_bytes: int = 1 << 18, fanout: int = 16, levels: int = 4) -> DataFrame:
    """Records in which two replicas differ: ``file``, ``record_id``, ``fault`` (``changed``, ``missing`` in the right
    replica, or ``extra`` there), ``offset`` (in the left replica, else in the right one), and ``nodes_differing``, how
    many leaves of the file differ.

    Both sides are record tables as ``record_table`` gives them. Descends only into ranges whose hashes differ; records of
    equal ranges are never compared. A lost or added record moves all offsets behind it, so those ranges are looked at
    record by record; moved records with equal digests are no faults. Equal replicas, or two empty ones, give no rows. A
    record with a null id is compared by its digest. Records that repeat in id and digest are counted: of a different
    number the surplus is one fault per id and digest.
    """
    a, b = merkle_tree(left, leaf_bytes, fanout, levels), merkle_tree(right, leaf_bytes, fanout, levels)

    def differing(x: DataFrame, y: DataFrame) -> DataFrame:
        both = x.withColumnRenamed("hash", "l").join(y.withColumnRenamed("hash", "r"), ["file", "node"], "full")
        return both.filter(~F.col("l").eqNullSafe(F.col("r"))).select("file", "node")

    open_nodes = differing(a[levels], b[levels])
    for level in range(levels - 1, -1, -1):
        up = F.lit(0).cast("long") if level == levels - 1 else F.floor(F.col("node") / fanout)

        def below(side: DataFrame) -> DataFrame:
            parents = open_nodes.withColumnRenamed("node", "up")
            return side.withColumn("up", up).join(parents, ["file", "up"], "left_semi").drop("up")

        open_nodes = differing(below(a[level]), below(b[level]))
    ranges = stored(open_nodes, "ranges")

    def inside(records: DataFrame, side: str) -> DataFrame:
        keyed = records.withColumn("node", F.floor(F.col("offset") / leaf_bytes)).join(ranges, ["file", "node"], "left_semi")
        return keyed.groupBy("file", "record_id", "digest").agg(
            F.count(F.lit(1)).alias(f"n_{side}"), F.min("offset").alias(f"at_{side}")
        )

    def key(side: DataFrame, s: str) -> DataFrame:
        return side.select("file", F.coalesce(F.col("record_id").cast("string"), F.lit("-")).alias("id_key"),
                           F.col("record_id").alias(f"id_{s}"), "digest", f"n_{s}", f"at_{s}")

    x, y = key(inside(left, "l"), "l"), key(inside(right, "r"), "r")
    pairs = x.join(y, ["file", "id_key", "digest"], "full")
    odd = pairs.filter(F.coalesce("n_l", F.lit(0)) != F.coalesce("n_r", F.lit(0)))
    # a digest that only the left has and one that only the right has, of one id: the record changed
    both = odd.groupBy("file", "id_key").agg(
        F.coalesce(F.max("id_l"), F.max("id_r")).alias("record_id"), F.coalesce(F.min("at_l"), F.min("at_r")).alias("offset"),
        F.sum(F.when(F.coalesce("n_l", F.lit(0)) > F.coalesce("n_r", F.lit(0)), 1).otherwise(0)).alias("more_l"),
        F.sum(F.when(F.coalesce("n_l", F.lit(0)) < F.coalesce("n_r", F.lit(0)), 1).otherwise(0)).alias("more_r"),
    )
    fault = F.when((F.col("more_l") > 0) & (F.col("more_r") > 0), "changed").when(F.col("more_l") > 0, "missing").otherwise("extra")
    counted = ranges.groupBy("file").agg(F.count(F.lit(1)).alias("nodes_differing"))
    return both.select("file", "record_id", fault.alias("fault"), "offset").join(counted, "file")
