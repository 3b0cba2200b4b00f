"""Registered queries of the subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from importlib import import_module

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.llm import alignment, decontaminate, embedding_dedup, fixity, line_dedup, mixing, periodic_runs, pitman_yor, quality, rtree_join
from faultline.llm import sharding, token_files, url_reputation
from faultline.llm.storage import send_package, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    send_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.filter_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def _other_bytes(text: Column) -> Column:
    """``text`` with other bytes in place of its first character, as many."""
    first = F.substring(text, 1, 1)
    other = F.when(first == "x", F.lit("y")).otherwise(F.lit("x"))
    return F.concat(F.repeat(other, F.octet_length(first)), F.substring(text, 2, 2**31 - 1))


def damaged(pages: DataFrame) -> DataFrame:
    """The pages of a second replica with damage that follows from the ids: every 101st has other bytes of the same length
    in its payload (without one in its address, without either a byte too many), every 211th is lost (what follows in its
    file moves up)."""
    hit = F.coalesce(F.col("page_id") % 101 == 7, F.lit(False))
    html, url = F.coalesce(F.octet_length("html"), F.lit(0)) > 0, F.coalesce(F.octet_length("url"), F.lit(0)) > 0
    return pages.filter(F.coalesce(F.col("page_id") % 211 != 13, F.lit(True))).select(
        "page_id",
        F.when(hit & ~html & url, _other_bytes(F.col("url"))).otherwise(F.col("url")).alias("url"),
        F.when(hit & html, _other_bytes(F.col("html"))).when(hit & ~url, F.lit("x")).otherwise(F.col("html")).alias("html"),
    )


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    files = fixity.null_id_files(pages)
    left = stored(fixity.record_table(pages, null_files=files), "records")
    right = stored(fixity.record_table(damaged(pages), null_files=files), "replica")
    found = fixity.audit(left, right)
    return found.select(F.col("record_id").alias("page_id"), "file", "fault", F.col("offset").cast("long").alias("offset"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return sharding.shuffle_into_shards(docs).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_rtree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rtree_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(_table(spark, sf_dir, "documents"))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_tokens(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end=2)
    return token_files.read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model")
    aligned = alignment.align(_table(spark, sf_dir, "documents"), a, b)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    kept = [c for c in aligned.columns if c != "groups"]
    out = alignment.scored(stored(aligned.select(*kept, digest), "aligned"), alignment.pair_bits(a, b))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def repeated_words(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place of a document: those of every tenth document repeat from some place on."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a, i = g % n, np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(_table(spark, sf_dir, "documents"), rewrite=repeated_words)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    out = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return out.select(
        "doc_id", "n_runs", (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"), F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )


_STRIP = r"regexp_replace({0}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_line_dedup": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM d),
k AS (SELECT doc_id, pos, line, {_LOW.format(_STRIP.format('line'))} AS line_key FROM x),
shared AS (SELECT line_key, min(doc_id) AS owner FROM k WHERE length(line_key) >= 10
           GROUP BY line_key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.doc_id, k.pos, k.line, s.owner IS NOT NULL AND s.owner <> k.doc_id AS gone
      FROM k LEFT JOIN shared s ON k.line_key = s.line_key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op4_url_reputation": """
WITH p AS (SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
l AS (SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM p LEFT JOIN l ON page_id = doc_id GROUP BY host),
h1 AS (SELECT *, regexp_extract(host, '([^.]*)$', 1) AS suffix FROM h0),
h AS (SELECT *, CASE WHEN length(host) <= length(suffix) + 1 THEN host
                ELSE regexp_extract(host, '([^.]*[.][^.]*)$', 1) END AS domain FROM h1),
g AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) AS m FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY suffix),
ks AS (SELECT least(greatest(coalesce(sum(round((bad - n * m) * (bad - n * m) - n * m * (1 - m), 6)) / nullif(sum(round(n * (n - 1) * m * (1 - m), 6)), 0), 0), 0.001), 0.9) AS r FROM s0, g),
s AS (SELECT suffix, (bad + (round(1 / r - 1, 6)) * m) / (n + round(1 / r - 1, 6)) AS sm FROM s0, g, ks),
d0 AS (SELECT domain, h.suffix, any_value(sm) AS sm, sum(n) AS n, sum(bad) AS bad FROM h JOIN s ON h.suffix = s.suffix GROUP BY domain, h.suffix),
kd AS (SELECT least(greatest(coalesce(sum(round((bad - n * sm) * (bad - n * sm) - n * sm * (1 - sm), 6)) / nullif(sum(round(n * (n - 1) * sm * (1 - sm), 6)), 0), 0), 0.001), 0.9) AS r FROM d0),
d AS (SELECT domain, (bad + round(1 / r - 1, 6) * sm) / (n + round(1 / r - 1, 6)) AS dm FROM d0, kd),
j AS (SELECT h.host, n, bad, dm FROM h JOIN d ON h.domain = d.domain),
kh AS (SELECT least(greatest(coalesce(sum(round((bad - n * dm) * (bad - n * dm) - n * dm * (1 - dm), 6)) / nullif(sum(round(n * (n - 1) * dm * (1 - dm), 6)), 0), 0), 0.001), 0.9) AS r FROM j),
q AS (SELECT host, bad + round(1 / r - 1, 6) * dm AS a, n - bad + round(1 / r - 1, 6) * (1 - dm) AS b, n + round(1 / r - 1, 6) AS t FROM j, kh),
low AS (SELECT host, greatest(a / t - 1.645 * sqrt(a * b / (t * t * (t + 1))), 0.0) AS bad_low FROM q),
f AS (SELECT page_id, p.host, path, bad_low,
    CASE WHEN (p.host = 'example.net' OR ends_with(p.host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (p.host = 'example.com' OR ends_with(p.host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (p.host = 'org' OR ends_with(p.host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (p.host = 'net' OR ends_with(p.host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM p JOIN low ON p.host = low.host)
SELECT page_id, host, path, rule, bad_low,
    CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
         ELSE CASE WHEN bad_low > 0.2 THEN 'block' ELSE 'allow' END END AS verdict
FROM f""",
    "op5_warc_fixity": """
WITH r AS (SELECT page_id, CAST(floor(page_id / 1000.0) AS BIGINT) AS file,
    strlen('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
      || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
      || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS length FROM pages),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM r)
SELECT page_id, file, CASE WHEN page_id % 211 = 13 THEN 'missing' ELSE 'changed' END AS fault, CAST("offset" AS BIGINT) AS "offset"
FROM o WHERE page_id % 101 = 7 OR page_id % 211 = 13""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of the subpackage by name, the pipeline included."""
    own = {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}
    return own | {"pipeline": import_module("corpus_pipeline").run}


def oracle_sql() -> dict[str, str]:
    whole = import_module("corpus_pipeline").ORACLE_SQL
    return ORACLES | ({"pipeline": whole} if whole else {})
