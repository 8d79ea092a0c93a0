"""Introductions of encyclopedia pages over the network, in partitions of id batches, and the manifest of what was fetched.

``spark.dataSource.register(PageSource)``, then

    spark.read.format("encyclopedia").option("api", url).option("ids", "1,2,3").load()      # pinned pages
    spark.read.format("encyclopedia").option("api", url).option("random", "400").load()     # as many random ones

Each partition asks for its batches one by one, waits longer from attempt to attempt, and keeps what it has when a batch fails for good: the pages of that
batch come as rows with an ``error``, so one batch costs no other. Pages that come twice are dropped by ``usable``. ``fetch`` takes ids from a table, however many.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from inkspan.functions.text import pick_sentence, safe_name
from inkspan.operators.corpora import exact_digest, unambiguous

SCHEMA = "pageid long, revid long, title string, text string, error string"
#: Fixed values of the service: pages of one request, attempts, seconds to wait for each kind of trouble (times the attempt), shortest text of a note.
BATCH, ATTEMPTS = 20, 6
WAITS = {"network": 1.0, "maxlag": 2.0, "busy": 5.0}
LEAST_TEXT = 100


class Failed(Exception):
    """A request that will not succeed."""


@dataclass
class Client:
    """Requests to one service. ``pause`` scales the waits."""

    api: str
    agent: str = "corpus builder"
    pause: float = 1.0
    timeout: float = 30.0

    def ask(self, **parameters: Any) -> dict:
        """The answer; network trouble, lag and busy servers are asked again."""
        url = f"{self.api}?{urllib.parse.urlencode({'format': 'json', 'formatversion': 2, 'maxlag': 5, **parameters})}"
        trouble = ""
        for attempt in range(1, ATTEMPTS + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": self.agent}), timeout=self.timeout) as got:
                    answer = json.load(got)
            except urllib.error.HTTPError as error:
                if error.code != 429 and error.code < 500:
                    raise Failed(f"http-{error.code}") from None
                trouble, kind = f"http-{error.code}", "busy"
            except (OSError, ValueError) as error:
                trouble, kind = f"network: {type(error).__name__}", "network"
            else:
                code = (answer.get("error") or {}).get("code")
                if code is None:
                    return answer
                if code != "maxlag":
                    raise Failed(f"api: {code}")
                trouble, kind = "maxlag", "maxlag"
            if attempt < ATTEMPTS:
                time.sleep(self.pause * WAITS[kind] * attempt)
        raise Failed(trouble)

    def pages(self, **which: Any) -> list[tuple]:
        """(pageid, revid, title, text, error) of one request; pages without text are left out."""
        answer = self.ask(action="query", prop="extracts|revisions", explaintext=1, exintro=1, exlimit=BATCH, rvprop="ids", **which)
        rows = (answer.get("query") or {}).get("pages") or []
        return [(p["pageid"], (p.get("revisions") or [{}])[0].get("revid"), p.get("title"), p["extract"], None) for p in rows if p.get("extract")]


def of_ids(client: Client, ids: list[int]) -> Iterator[tuple]:
    """Pages of ids, batch by batch; a batch that fails leaves a row with the error for each id."""
    for at in range(0, len(ids), BATCH):
        batch = ids[at : at + BATCH]
        try:
            yield from client.pages(pageids="|".join(map(str, batch)))
        except Failed as error:
            yield from ((k, None, None, None, str(error)) for k in batch)


@dataclass
class _Part(InputPartition):
    ids: list[int]
    random: int = 0


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.client = Client(options["api"], options.get("agent", Client.agent), float(options.get("pause", "1")))
        self.ids = list(dict.fromkeys(int(k) for k in options.get("ids", "").split(",") if k.strip()))
        self.random, self.batches = int(options.get("random", "0")), int(options.get("batchesPerPartition", "10"))

    def partitions(self) -> list[InputPartition]:
        size = BATCH * self.batches
        parts = [_Part(self.ids[at : at + size]) for at in range(0, len(self.ids), size)]
        return parts + [_Part([], min(size, self.random - at)) for at in range(0, self.random, size)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from of_ids(self.client, partition.ids)
        left, empty = partition.random, 0
        while left > 0 and empty < ATTEMPTS:
            try:
                got = self.client.pages(generator="random", grnnamespace=0, grnlimit=min(BATCH, left))
            except Failed as error:
                yield (None, None, None, None, str(error))
                return
            empty = 0 if got else empty + 1
            left -= len(got)
            yield from got


class PageSource(DataSource):
    """Options: api; ids or random; agent, pause, batchesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "encyclopedia"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(self.options)


def fetch(ids: DataFrame, client: Client, partitions: int | None = None) -> DataFrame:
    """Pages of a table of ids (pageid), as PageSource gives them; ``partitions`` bounds how many requests run at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            rows = list(of_ids(client, batch.column(0).to_pylist()))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["pageid", "revid", "title", "text", "error"])

    wanted = ids.select(F.col("pageid").cast("long").alias("pageid")).where("pageid is not null").distinct()
    return (wanted.repartition(partitions, "pageid") if partitions else wanted).mapInArrow(run, SCHEMA)


def usable(pages: DataFrame) -> DataFrame:
    """(pageid, revid, title, text, path): each page once, those that failed or are too short left out."""
    trimmed = F.trim("text")
    kept = pages.where(F.col("error").isNull() & (F.length(trimmed) >= LEAST_TEXT))
    once = kept.groupBy("pageid").agg(F.max_by(F.struct("revid", "title", trimmed.alias("text")), F.coalesce("revid", F.lit(-1))).alias("p")).select("pageid", "p.*")
    return once.withColumn("path", F.concat(safe_name(F.col("title")), F.lit(".md")))


def truth_of(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, queries, relevance): a note for each page, and one sentence of it that no other note has as its query."""
    notes = pages.select("path", "title", F.concat(F.lit("# "), "title", F.lit("\n\n"), "text", F.lit("\n")).alias("text"))
    chosen = pages.select("pageid", "path", pick_sentence(F.col("text"), F.col("title"), F.col("pageid")).alias("sentence")).where("sentence is not null")
    alone = unambiguous(chosen).select(F.concat(F.lit("w"), F.col("pageid").cast("string")).alias("key"), "sentence", "path")
    return notes, alone.select("key", F.lit("literal").alias("kind"), F.col("sentence").alias("query")), alone.select("key", "path", F.lit(2).alias("grade"))


def sentence_owners(sentences: DataFrame) -> DataFrame:
    """(sentence, owners, n): how many notes have a sentence, the first eight of them by path."""
    owners = sentences.select("sentence", "path").distinct()
    first = F.slice(F.sort_array(F.collect_list("path")), 1, 8)
    shared = owners.groupBy("sentence").agg(F.count("*").alias("n"))
    # names are gathered of sentences that few notes have; of others the count says enough
    few = owners.join(shared.where("n <= 64"), "sentence").groupBy("sentence").agg(first.alias("owners"))
    return shared.join(few, "sentence", "left").select("sentence", "owners", "n")


def revision_text() -> Column:
    return F.concat(F.col("pageid").cast("string"), F.lit(":"), F.coalesce(F.col("revid").cast("string"), F.lit("null")))


def revision_hash(pages: DataFrame) -> DataFrame:
    """(n, digest): 16 digits of the SHA-256 of ``pageid:revid`` of all pages, sorted as text, a line each."""
    rows = pages.select(revision_text().alias("r"))
    first = rows.agg(F.min("r").alias("first"))
    lines = rows.join(F.broadcast(first)).withColumn("line", F.when(F.col("r") == F.col("first"), F.col("r")).otherwise(F.concat(F.lit("\n"), "r")))  # one row
    return exact_digest(lines, F.col("line"), "r").select("n", F.left("digest", F.lit(16)).alias("digest"))


def write_manifest(pages: DataFrame, path: str, source: str) -> None:
    """``articles`` (pageid, revid, title, path) as a table and, last, ``header`` with the count and the revision hash; a manifest without header is not whole."""
    pages.select("pageid", "revid", "title", "path").write.mode("overwrite").json(f"{path}/articles")
    head = revision_hash(pages).select(F.lit(source).alias("source"), F.col("n").alias("articles"), F.col("digest").alias("corpus_hash"), F.current_timestamp().alias("fetched_at"))
    head.coalesce(1).write.mode("overwrite").json(f"{path}/header")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(pageid, revid, title, path) of a manifest: the ids that pin a corpus."""
    return spark.read.schema("pageid long, revid long, title string, path string").json(f"{path}/articles")


def manifest_is_whole(spark: SparkSession, path: str) -> Callable[[DataFrame], bool]:
    """Whether pages are those of the manifest, by their revisions."""
    known = spark.read.schema("corpus_hash string").json(f"{path}/header").first()["corpus_hash"]
    return lambda pages: revision_hash(pages).first()["digest"] == known
