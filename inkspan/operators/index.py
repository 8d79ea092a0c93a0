"""The inverted index as tables: chunks, postings, document frequencies and field statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions import text as tx
from inkspan.operators.chunk import chunk, with_ids
from inkspan.saving import write_clean

#: Field numbers and their weights: title, heading, body.
FIELDS = {"title": 0, "heading": 1, "text": 2}
FIELD_WEIGHTS = {0: 3.0, 1: 1.5, 2: 1.0}


@dataclass
class Index:
    """chunks (id, path, title, heading, text, start_line, ordinal); postings (field, term, id, tf, dl); term_df (field, term, df); stats (field, n, total)."""

    chunks: DataFrame
    postings: DataFrame
    term_df: DataFrame
    stats: DataFrame
    tokenizer: tx.Tokenizer = tx.tokens
    stable: bool = False
    #: Whether the other tables follow from ``chunks`` alone, so that they may be made from saved chunks.
    derived: bool = False
    #: (path, dl_0, dl_1, dl_2) of every chunk, if it is known without the chunks' texts.
    lengths: DataFrame | None = None

    def persist(self) -> Index:
        for table in (self.chunks, self.postings, self.term_df, self.stats):
            table.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        for table in (self.chunks, self.postings, self.term_df, self.stats):
            table.unpersist()

    def save(self, path: str) -> None:
        """Parquet tables; postings are ranged by term, so a search reads the row groups of its terms only.

        Each table is made from the one saved before it: notes are read and cut once, chunks tokenized once.
        """
        spark = self.chunks.sparkSession

        def put(table: DataFrame, name: str) -> DataFrame:
            write_clean(spark, table.write.mode("overwrite"), f"{path}/{name}")
            return spark.read.schema(table.schema).parquet(f"{path}/{name}")

        chunks = put(self.chunks, "chunks")
        postings = postings_of(chunks, self.tokenizer, self.stable) if self.derived else self.postings
        postings = put(postings.repartitionByRange("term", "field").sortWithinPartitions("term", "field"), "postings")
        put(frequencies(postings).repartitionByRange("term").sortWithinPartitions("term"), "term_df")
        put(statistics(chunks, postings).coalesce(1), "stats")

    @staticmethod
    def load(spark: SparkSession, path: str, tokenizer: tx.Tokenizer = tx.tokens, stable: bool = False) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("chunks", "postings", "term_df", "stats")), tokenizer, stable)

    def size(self) -> DataFrame:
        """One row: n_notes with a chunk, n_chunks."""
        return self.chunks.agg(F.countDistinct("path").alias("n_notes"), F.count("*").alias("n_chunks"))


def field_tokens(chunks: DataFrame, tokenizer: tx.Tokenizer = tx.tokens, stable: bool = False) -> DataFrame:
    """(id, field, tokens) for the three fields of each chunk."""
    bags = [F.struct(F.lit(n).alias("field"), tokenizer(tx.fold(F.col(name), stable)).alias("tokens")) for name, n in FIELDS.items()]
    return chunks.select("id", F.explode(F.array(*bags)).alias("_b")).select("id", "_b.field", "_b.tokens")


def postings_of(chunks: DataFrame, tokenizer: tx.Tokenizer = tx.tokens, stable: bool = False) -> DataFrame:
    """(field, term, id, tf, dl) of chunks; one shuffle, tf is summed in the map tasks first."""
    terms = field_tokens(chunks, tokenizer, stable).select("id", "field", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return terms.groupBy("field", "term", "id").agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl"))


def frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"))


def statistics(chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """(field, n, total): every chunk has every field; the tokens of a field are the sum of its postings' tf."""
    totals = postings.groupBy("field").agg(F.sum("tf").alias("total"))
    fields = chunks.sparkSession.createDataFrame([(n,) for n in FIELDS.values()], "field int").join(F.broadcast(totals), "field", "left")  # three rows
    return fields.join(F.broadcast(chunks.agg(F.count("*").alias("n")))).select("field", "n", F.coalesce("total", F.lit(0).cast("long")).alias("total"))


def vocabulary(chunks: DataFrame, tokenizer: tx.Tokenizer = tx.tokens, stable: bool = False) -> DataFrame:
    """(field, term, df, total): how many chunks have a term; a row without term has the number of chunks and of tokens of the field. One pass, no postings."""
    terms = field_tokens(chunks, tokenizer, stable).select("field", F.size("tokens").cast("long").alias("dl"), F.explode(F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string")))).alias("term"))
    return terms.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("total"))


def lengths_of(chunks: DataFrame, tokenizer: tx.Tokenizer = tx.tokens, stable: bool = False) -> DataFrame:
    """(path, dl_0, dl_1, dl_2): the number of tokens in each field of each chunk."""
    return chunks.select("path", *(F.size(tokenizer(tx.fold(F.col(name), stable))).cast("long").alias(f"dl_{n}") for name, n in FIELDS.items()))


def sums_of(lengths: DataFrame) -> DataFrame:
    """``statistics`` from the lengths of fields."""
    row = lengths.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(f"dl_{f}"), F.lit(0).cast("long")).alias(f"t_{f}") for f in FIELDS.values()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col("n"), F.col(f"t_{f}").alias("total")) for f in FIELDS.values()))).alias("s")).select("s.*")


def from_chunks(chunks: DataFrame, tokenizer: tx.Tokenizer = tx.tokens, stable: bool = False) -> Index:
    """Tables of an index over chunks that have ids."""
    postings, lengths = postings_of(chunks, tokenizer, stable), lengths_of(chunks, tokenizer, stable)
    return Index(chunks, postings, frequencies(postings), sums_of(lengths), tokenizer, stable, True, lengths)


def with_native_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("id", F.concat_ws("#", "path", "ordinal", F.hex(F.xxhash64("text"))))


def build(notes: DataFrame, tokenizer: tx.Tokenizer = tx.tokens, stable: bool = False, plain_only: bool = False, native_ids: bool = False) -> Index:
    """Index of notes (path, title, text). ``native_ids`` takes a JVM hash in place of the compatible id."""
    chunks = chunk(notes, plain_only)
    if native_ids:
        chunks = with_native_ids(chunks)
    else:
        chunks = with_ids(chunks)
    return from_chunks(chunks, tokenizer, stable)


def upsert(index: Index, notes: DataFrame) -> Index:
    """The index with these notes in place of what their paths had; oversized and blank notes only remove.

    Postings of other notes are kept as they are (an anti-join by chunk id), only the new notes are tokenized.
    """
    return replace_notes(index, notes.select("path"), with_ids(chunk(notes)))


def replace_notes(index: Index, paths: DataFrame, chunks: DataFrame) -> Index:
    """``upsert`` with the chunks (with ids) that the notes of ``paths`` have now."""
    return _replace(index, paths.select("path").distinct(), from_chunks(chunks, index.tokenizer, index.stable))


def remove(index: Index, paths: DataFrame) -> Index:
    """The index without these paths; unknown paths change nothing."""
    return _replace(index, paths.select("path").distinct(), None)


def _replace(index: Index, paths: DataFrame, fresh: Index | None) -> Index:
    # marks and lengths are narrow; texts meet the paths only where chunks are read
    gone = index.chunks.select("path", "id").join(paths.hint("shuffle_hash"), "path", "left_semi").select("id")
    chunks = index.chunks.join(paths.hint("shuffle_hash"), "path", "left_anti")
    postings = index.postings.join(gone.hint("shuffle_hash"), "id", "left_anti").select(*index.postings.columns)
    lengths = (lengths_of(index.chunks, index.tokenizer, index.stable) if index.lengths is None else index.lengths).join(paths.hint("shuffle_hash"), "path", "left_anti")
    if fresh:
        chunks, postings, lengths = chunks.unionByName(fresh.chunks), postings.unionByName(fresh.postings), lengths.unionByName(fresh.lengths)
    return Index(chunks, postings, frequencies(postings), sums_of(lengths), index.tokenizer, index.stable, lengths=lengths)


def clear(index: Index) -> Index:
    """An index of the same shape without notes."""
    return from_chunks(index.chunks.limit(0), index.tokenizer, index.stable)
