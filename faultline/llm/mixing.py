"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Every source is a stream of words: its documents in a seeded order, spread over hash shards of bounded size, and each
(source, shard) cell is cut into blocks of ``block`` words. Blocks are seats: the sources get them by highest quotients
``target / (2 seats + 1)``, and the quota of a source goes to its cells in the same way by their words. A cell then takes
all its blocks as often as the quota covers them, and the rest as a run of blocks from a seeded place.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.functions.hashing import hash_number
from faultline.llm.storage import stored

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def sainte_lague(cells: DataFrame, group: Sequence[str], key: Sequence[str], weight: str, seats: str) -> DataFrame:
    """Seats per row of ``cells``: ``key`` columns and ``quota``. ``seats`` (the same value in all rows of a group) are
    given one by one to the highest ``weight / (2 s + 1)``, ties to the smaller key. Seats that every row is sure to get
    (its share rounded down, less one) are not counted one by one."""
    whole = Window.partitionBy(*group)
    share = F.coalesce(F.floor(F.col(seats) * F.col(weight) / F.nullif(F.sum(weight).over(whole), F.lit(0))), F.lit(0))
    based = cells.withColumn("base", F.greatest(share - 1, F.lit(0))).withColumn(
        "open", F.col(seats) - F.sum("base").over(whole)
    )
    each = based.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn(
        "rank",
        F.row_number().over(whole.orderBy(F.desc(F.col(weight) / (2 * (F.col("base") + F.col("s")) + 1)), *key, "s")),
    )
    won = F.sum(F.when((F.col("rank") <= F.col("open")) & (F.col(weight) > 0), 1).otherwise(0))
    return each.groupBy(*key).agg((F.first("base") + won).cast("long").alias("quota"))


def source_targets(totals: DataFrame, weights: Sequence[float], epochs: float, most: float) -> DataFrame:
    """``source_key`` -> ``target``: shares of ``epochs`` times all words by weight (sources in code-point order, null
    last, weights repeating), none above ``most`` times its words; what a full source leaves is shared by weight among
    the others until none is above.

    Sources fill up in order of words per weight, so the fill level is found from running sums over that order. ``totals``
    has one row per source."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    t = totals.withColumn("w", F.get(listed, F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))))
    t = t.withColumn("room", F.lit(float(most)) * F.col("words")).withColumn("all", F.sum("words").over(every) * epochs)
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("room") / F.col("w"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("all") - F.coalesce(F.sum("room").over(upto), F.lit(0.0))
    weight_left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))
    t = t.withColumn("level", left / weight_left).withColumn("full", F.col("room") / F.col("w") <= F.col("level"))
    # the level of the first source that is not full holds for all that follow
    final = F.min(F.when(~F.col("full"), F.struct((F.col("room") / F.col("w")).alias("o"), "level"))).over(every)["level"]
    target = F.when(F.col("full"), F.col("room")).otherwise(final * F.col("w"))
    return t.select("source_key", "words", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: float = 1.5, most: float = 2.0, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", block: int = 64, shard_words: int = 4_000_000, seed: int = 29,
) -> DataFrame:
    """One row per input row: ``id_col``, ``source_col``, ``size``, ``source_size``, ``target`` (its source's), ``taken``.

    ``taken`` counts the words the mix takes from the document, repeats counted; it never exceeds ``most`` rounded up
    times the size. Summed by source it misses ``target`` by about a block per shard at most. Reruns agree: all choices
    follow from ``seed``, id and text.

    Defined cases: a null or empty text has size 0 and takes 0. Null is a source of its own, last in order. Rows with a
    null id are placed by their text; repeated rows count each. A table without words has targets 0; an empty one gives
    an empty result. Other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        # one non-null join key per source: null and the text "null" stay apart
        F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col))).alias("source_key"),
        word_count(text).alias("size"),
        F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(seed), text)).otherwise(hash_number(seed, F.col(id_col))).alias("h"),
    )
    sized = stored(rows, "mix-sizes")
    total = sized.agg(F.sum("size")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_words))
    sized = sized.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int"))

    cells = sized.groupBy("source", "source_key", "shard").agg(F.sum("size").alias("cell_words"))
    totals = cells.groupBy("source", "source_key").agg(F.sum("cell_words").alias("words"))
    targets = source_targets(totals, weights, epochs, most)
    seats = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long")
    quotas = sainte_lague(
        targets.withColumn("seats", seats).withColumn("one", F.lit(0)), ["one"], ["source_key"], "target", "seats"
    ).withColumnRenamed("quota", "source_quota")
    cell_quota = sainte_lague(
        cells.join(quotas, "source_key"), ["source_key"], ["source_key", "shard"], "cell_words", "source_quota"
    )
    blocks = F.ceil(F.col("cell_words") / block).cast("long")
    plan = (
        cells.join(cell_quota, ["source_key", "shard"]).join(targets, "source_key")
        .withColumn("blocks", F.greatest(blocks, F.lit(1).cast("long")))
        .withColumn("quota", F.least("quota", (F.col("blocks") * most).cast("long")))
        .select(
            "source_key", "shard", "target", F.col("words").alias("source_size"),
            F.floor(F.col("quota") / F.col("blocks")).alias("passes"),
            F.pmod(F.col("quota"), F.col("blocks")).alias("run"), "blocks",
            F.pmod(hash_number(seed + 1, F.col("source_key"), F.col("shard")), F.col("blocks")).alias("at"),
        )
    )
    # a cell has shard_words words or so, so its documents fit in one task
    stream = Window.partitionBy("source_key", "shard").orderBy("h", F.col("id").asc_nulls_last(), "size")
    begin = F.coalesce(F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("a", begin).withColumn("b", F.col("a") + F.col("size")).join(plan, ["source_key", "shard"], "left")

    def shared(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("b"), high) - F.greatest(F.col("a"), low))

    ends = F.col("at") + F.col("run")
    chosen = shared(F.col("at") * block, F.least(ends, F.col("blocks")) * block) + shared(
        F.lit(0), F.greatest(ends - F.col("blocks"), F.lit(0)) * block
    )
    return placed.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"), (F.col("passes") * F.col("size") + chosen).cast("long").alias("taken"),
    )
