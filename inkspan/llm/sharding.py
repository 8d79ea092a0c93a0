"""Sharding by proportional stratified interleaving.

Rows of each source are ranked in a seeded random order; all rows are then sorted by their
fractional rank (2k - 1) / 2n within their source and the sequence is cut into ``shards`` equal
runs. Every run thus holds each source in its share of the whole, to within one row.

Law ``rows``: counts of any two shards differ by one at most. The random order goes by the text, so equal texts of a source are
neighbours and those of other sources get about the same fractional rank: a group of copies lies in few shards, parted by the
cuts where it must be, as equal counts allow no more for a group of a third of all rows.

Scale: two range shuffles of narrow rows (no text is moved). A hot source is split over ranges by its
seeded order, so no task holds a source.

Defined cases: rows of one source and text go by doc_id; texts are taken whole, whatever their length; a null source is a stratum of its own; a null text has no bytes (size 1, crc32 0);
rows with a null doc_id are ordered by crc32 and size; repeated rows are each placed; an empty
table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import lookup_join, ordered_positions, read_table, stage


def interleave(docs: DataFrame, shards: int = 8, seed: int = 17, source: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, position (global), shard, slot for every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.concat(F.lit(f"{seed}:"), text).cast("binary")
    rows = docs.select(
        "doc_id",
        F.col(source).cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.substring(F.md5(key), 1, 16).alias("_shuffle"),
    )
    ranked = stage(ordered_positions(rows, ["source", "_shuffle", "doc_id", "text_crc32", "size"], "_pos"))
    strata = stage(ranked.groupBy("source").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first")).withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))).drop("source"))
    ranked = lookup_join(ranked.withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))), strata, ["_source"])
    ranked = ranked.withColumn("_rank", F.col("_pos") - F.col("_first") + 1).withColumn("_frac", (2 * F.col("_rank") - 1) / (2 * F.col("_n")))
    placed = ordered_positions(ranked.select("doc_id", "source", "size", "text_crc32", "_frac", "_rank"), ["_frac", "source", "_rank"], "position")
    total = strata.agg(F.coalesce(F.sum("_n"), F.lit(1))).first()[0]
    return (
        placed.withColumn("shard", F.expr(f"(position * {shards}) div {total}L").cast("int"))
        .withColumn("slot", F.expr(f"position - (shard * {total}L + {shards - 1}) div {shards}"))
        .select("doc_id", "source", "size", "text_crc32", "position", "shard", "slot")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
