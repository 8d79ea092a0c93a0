"""Corpora and their truth: containment and single-word queries, ambiguous sentences, noise, hashes, diffs."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions import text as tx
from inkspan.saving import discard, scratch, write_clean


#: Words, or characters of passages of less than three words, that an anchor has at most.
ANCHOR_WORDS, ANCHOR_CHARACTERS = 4, 6
#: Grams of passages up to which they are broadcast; a gram is one long.
BROADCAST_GRAMS = 1_000_000
#: Paths of notes that may have a passage up to which they are broadcast, so that no other text is shuffled.
BROADCAST_PATHS = 200_000


def _word_grams(text: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words without the first and the last word, which may be parts of longer ones."""

    def runs(words: Column) -> Column:
        words = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
        last = F.size(words) - (size - 1)
        found = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.lit(size), F.slice(words, i, F.lit(size))))
        return F.when(last >= 1, F.array_distinct(found)).otherwise(F.array().cast("array<bigint>"))

    # an array of one, so that the text is split once and not for every run
    return F.flatten(F.transform(F.array(F.split(text, " ")), runs))


def _grams_of_words(notes: DataFrame, sizes: list[int]) -> DataFrame:
    """(path, gram): the hashes of _word_grams() of all runs of words of the notes, the first and the last word too; one row a word and size, by generated code alone."""
    words = notes.select("path", F.split("text", " ").alias("_s")).select("path", "_s", F.explode(F.sequence(F.lit(0), F.size("_s") - 1)).alias("_i"))
    # a hash of an array is that of its elements one after the other
    grams = [F.when(F.col("_i") + size <= F.size("_s"), F.xxhash64(F.lit(size), *(F.get("_s", F.col("_i") + k) for k in range(size)))) for size in sizes]
    if len(grams) == 1:
        return words.select("path", grams[0].alias("gram"))
    return words.select("path", F.explode(F.array(*grams)).alias("gram"))


def _character_grams(text: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` characters, in one pass."""
    return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))), lambda g: F.xxhash64(F.lit(-size), g))


def passage_anchors(notes: DataFrame, passages: DataFrame) -> DataFrame:
    """(key, path, gram, df): notes that have the rarest gram of a passage, and how many notes have it.

    A note with the passage has every gram of it. Grams of the passages alone leave the scan of the notes; they are counted there, each passage takes
    the one that fewest notes have, and passages of which a gram is nowhere take none.
    """
    inner = F.size(F.split("query", " ")) - 2
    sized = passages.where("query is not null and query <> ''").withColumn("_w", F.least(inner, F.lit(ANCHOR_WORDS))).withColumn("_c", F.least(F.length("query"), F.lit(ANCHOR_CHARACTERS)))
    kinds = [(n, True) for n in range(1, ANCHOR_WORDS + 1)] + [(n, False) for n in range(1, ANCHOR_CHARACTERS + 1)]
    used = {(r["_w"], True) if r["_w"] > 0 else (r["_c"], False) for r in sized.select("_w", "_c").distinct().collect()}  # a few sizes
    asked, by_words, by_characters = [], [], []
    for size, by_word in (k for k in kinds if k in used):
        grams = _word_grams(F.col("query"), size) if by_word else _character_grams(F.col("query"), size)
        own = F.col("_w") == size if by_word else (F.col("_w") <= 0) & (F.col("_c") == size)
        asked.append(sized.where(own).select("key", F.explode(grams).alias("gram")))
        (by_words if by_word else by_characters).append(size)
    if not asked:
        return passages.sparkSession.createDataFrame([], "key string, path string, gram long, df long")
    asked = reduce(DataFrame.unionByName, asked).persist(StorageLevel.MEMORY_AND_DISK)
    wanted = asked.select("gram").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_GRAMS else wanted
    told = []
    if by_words:
        told.append(_grams_of_words(notes, by_words))
    if by_characters:
        told.append(notes.select("path", F.explode(F.concat(*(_character_grams(F.col("text"), size) for size in by_characters))).alias("gram")))
    held = reduce(DataFrame.unionByName, told).join(wanted, "gram", "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
    counts = held.distinct().groupBy("gram").agg(F.count("*").alias("df"))
    rarest = asked.join(counts, "gram", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("m")).where("m.df > 0")
    return held.join(rarest.select("key", "m.gram", "m.df"), "gram").select("key", "path", "gram", "df").distinct()


def passage_relevance(notes: DataFrame, passages: DataFrame, grade: int = 2, whole: int | None = None) -> DataFrame:
    """(key, path, grade): notes (path, text) that contain a passage (key, query) verbatim; ``whole`` is the grade of those that are the passage, if it is another.

    Paths and passages meet by the passage's rarest gram in the notes; texts join by path for the containment test alone, and only those of such paths.
    """
    pairs = passage_anchors(notes, passages).select("key", "path").join(passages.select("key", "query"), "key")
    paths = pairs.select("path").distinct().limit(BROADCAST_PATHS + 1).persist(StorageLevel.MEMORY_AND_DISK)
    texts = notes.select("path", "text")
    if paths.count() <= BROADCAST_PATHS:
        texts = texts.join(F.broadcast(paths), "path", "left_semi")
    found = pairs.join(texts, "path").where(F.contains("text", F.col("query")))
    marked = F.lit(grade) if whole is None else F.when(F.col("text") == F.col("query"), whole).otherwise(grade)
    return found.select("key", "path", marked.alias("grade")).distinct()


def word_relevance(notes: DataFrame, least: int = 3, most: int = 12, most_notes: int = 4, limit: int = 400) -> tuple[DataFrame, DataFrame]:
    """(queries, relevance) from Katakana words that few notes have: key ``k:<word>``, relevant are the notes with the word."""
    spans = F.array_distinct(F.regexp_extract_all(tx.fold(F.col("text")), F.lit(rf"([\p{{IsKatakana}}ー]{{{least},}})"), F.lit(1)))
    words = notes.select("path", F.explode(spans).alias("word"))
    chosen = words.groupBy("word").agg(F.count_distinct("path").alias("df")).where(F.col("df").between(1, most_notes) & F.length("word").between(least, most)).orderBy("word").limit(limit)
    key = F.concat(F.lit("k:"), F.col("word"))
    queries = chosen.select(key.alias("key"), F.lit("word").alias("kind"), F.col("word").alias("query"))
    return queries, words.join(F.broadcast(chosen.select("word")), "word").select(key.alias("key"), "path", F.lit(2).alias("grade"))  # at most ``limit`` rows


def bigram_noise(notes: DataFrame, words: DataFrame) -> DataFrame:
    """(word, noise): notes (path, text) that have a bigram of the word (word) but not the word as a run of its own.

    Both sides meet on bigrams; the runs that are the word itself leave by an anti-join.
    """
    folded = tx.fold(F.col("text"))
    pairs = F.regexp_extract_all("_t", F.lit("(?s)(?=(..))"), F.lit(1))  # one pass, where substrings by number would count from the start each time
    told = notes.select("path", folded.alias("_t")).where(F.length("_t") > 1).select("path", F.explode(F.array_distinct(pairs)).alias("bigram"))
    asked = words.select("word", F.explode(F.array_distinct(tx.bigrams(F.col("word")))).alias("bigram"))
    own = notes.select("path", F.explode(F.array_distinct(F.regexp_extract_all(folded, F.lit(r"([\p{IsKatakana}ー]+)"), F.lit(1)))).alias("word"))
    near = told.join(asked, "bigram").select("word", "path").distinct().join(own, ["word", "path"], "left_anti")
    return words.select("word").join(near.groupBy("word").agg(F.count("*").alias("noise")), "word", "left").select("word", F.coalesce("noise", F.lit(0)).alias("noise"))


def token_counts(texts: DataFrame, folded: Callable[[Column], Column], tokenizer: tx.Tokenizer = tx.tokens) -> DataFrame:
    """(term, n): how often the ``texts`` (text) have each token, folded by ``folded``.

    No token reaches over a space, so what lies between spaces is counted first and each such word is cut once, however often it occurs.
    """
    words = texts.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.select("n", F.explode(tokenizer(folded(F.col("word")))).alias("term")).groupBy("term").agg(F.sum("n").alias("n"))


def unambiguous(sentences: DataFrame) -> DataFrame:
    """Of (sentence, path) those whose sentence one note alone has."""
    shared = sentences.groupBy("sentence").agg(F.count_distinct("path").alias("_n")).where("_n > 1").select("sentence")
    return sentences.join(shared, "sentence", "left_anti")


def corpus_hash(notes: DataFrame) -> DataFrame:
    """One row: n_notes and a SHA-256 over the notes in the order of their paths.

    Each note is hashed where it lies; only (path, digest) pairs are ordered, in one task, so this is for corpora whose
    list of paths fits a task.
    """
    digest = F.sha2(F.concat("path", F.lit("\x01"), "text"), 256)
    rows = notes.select("path", digest.alias("d"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "d"))), lambda r: r["d"]), "")
    return rows.agg(F.count("*").alias("n_notes"), F.sha2(ordered, 256).alias("corpus_hash"))


def _stream_digest(batches):
    """SHA-256 of the pieces as they pass."""
    import hashlib

    import pyarrow as pa

    state, n = hashlib.sha256(), 0
    for batch in batches:
        for piece in batch.column(0).to_pylist():
            state.update((piece or "").encode())  # null: counted, no bytes
            n += 1
    yield pa.RecordBatch.from_pydict({"n": [n], "digest": [state.hexdigest()]})


def _sha256_library():
    """The C library below hashlib, whose SHA-256 can be stopped and taken up again; None where hashlib has no such library."""
    try:
        import _hashlib

        library = ctypes.CDLL(_hashlib.__file__)
        for name in ("SHA256_Init", "SHA256_Update", "SHA256_Final"):
            getattr(library, name)
    except (ImportError, OSError, AttributeError):
        return None
    library.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
    return library


#: Bytes of a state (the library's structure has 112).
_STATE = 256


def _digest_from(state: bytes | None) -> Callable[[Iterator], Iterator]:
    """A function that goes on with a SHA-256 from ``state`` (None: from its beginning) over the pieces that pass."""

    def go_on(batches):
        import pyarrow as pa

        library, n = _sha256_library(), 0
        held = ctypes.create_string_buffer(state, _STATE) if state else ctypes.create_string_buffer(_STATE)
        if not state:
            library.SHA256_Init(held)
        for batch in batches:
            for piece in batch.column(0).to_pylist():
                data = (piece or "").encode()  # null: counted, no bytes
                library.SHA256_Update(held, data, len(data))
                n += 1
        after, out = held.raw, ctypes.create_string_buffer(32)
        library.SHA256_Final(out, held)
        yield pa.RecordBatch.from_pydict({"n": [n], "digest": [out.raw.hex()], "state": [after]})

    return go_on


def exact_digest(pieces: DataFrame, piece: Column, *order: str) -> DataFrame:
    """One row (n, digest): SHA-256 of the pieces in order, one behind the other.

    A SHA-256 has no parallel form, but its state can be handed on: pieces are dealt to ranges of the order, and one task after the other
    sorts a range and goes on where the last one stopped, so that none reads more than its range. Where hashlib's library lets no state out,
    one task sorts (with spill) and streams all. ``hash_tree`` is the one to use at scale.
    """
    spark, cut = pieces.sparkSession, pieces.select(piece.alias("_p"), *order)
    if _sha256_library() is None:
        return cut.repartition(1).sortWithinPartitions(*order).select("_p").mapInArrow(_stream_digest, "n long, digest string")
    folder = scratch(spark)
    try:
        write_clean(spark, cut.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.partitionBy("_part"), folder)
        saved = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in cut.schema)}, _part int").parquet(folder)
        n, digest, state = 0, hashlib.sha256().hexdigest(), None
        for part in sorted(r["_part"] for r in saved.select("_part").distinct().collect()):  # a number for each range
            rows = saved.where(F.col("_part") == part).select("_p", *order).coalesce(1).sortWithinPartitions(*order).select("_p")
            row = rows.mapInArrow(_digest_from(state), "n long, digest string, state binary").first()
            n, digest, state = n + row["n"], row["digest"], bytes(row["state"])
    finally:
        discard(spark, folder)
    return spark.createDataFrame([(n, digest)], "n long, digest string")


def exact_corpus_hash(notes: DataFrame) -> DataFrame:
    """(n, digest) over ``path``, NUL, ``text``, NUL of the notes by path (in the order of UTF-8)."""
    return exact_digest(notes, F.concat(F.col("path"), F.lit("\x00"), F.col("text"), F.lit("\x00")), "path")


#: Hexadecimal digits of a path's SHA-256 that name its leaf.
TREE_DEPTH = 3


def hash_leaves(notes: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """(node, digest, n): leaves of a hash tree, by the first ``depth`` digits of the path's SHA-256.

    A note's digest is the SHA-256 of path, NUL and text, a leaf's that of its notes' digests in the order of the paths' SHA-256. With 16 ** depth
    leaves, ``depth`` sets how many notes a leaf has.
    """
    rows = notes.select(F.sha2("path", 256).alias("h"), F.sha2(F.concat(F.col("path"), F.lit("\x00"), F.col("text")), 256).alias("d"))
    gathered = rows.groupBy(F.left("h", F.lit(depth)).alias("node")).agg(F.sort_array(F.collect_list(F.struct("h", "d"))).alias("notes"))
    return gathered.select("node", F.sha2(F.array_join(F.transform("notes", lambda x: x["d"]), ""), 256).alias("digest"), F.size("notes").cast("long").alias("n"))


def hash_root(leaves: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """(n_notes, corpus_hash): a node is the SHA-256 of its children's digests in the order of their digit; at most 16 meet in a task's group."""
    level = leaves
    for k in range(depth - 1, -1, -1):
        gathered = level.groupBy(F.left("node", F.lit(k)).alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("c"), F.sum("n").alias("n"))
        level = gathered.select("node", F.sha2(F.array_join(F.transform("c", lambda x: x["digest"]), ""), 256).alias("digest"), "n")
    return level.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n_notes"), F.coalesce(F.max("digest"), F.sha2(F.lit("").cast("binary"), 256)).alias("corpus_hash"))


def update_leaves(leaves: DataFrame, notes: DataFrame, changed: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """The leaves after the notes of the paths ``changed`` changed, came or went: those leaves alone are made anew from ``notes``."""
    touched = changed.select(F.left(F.sha2("path", 256), F.lit(depth)).alias("node")).distinct()
    inside = notes.withColumn("node", F.left(F.sha2("path", 256), F.lit(depth))).join(touched, "node", "left_semi").drop("node")
    return leaves.join(touched, "node", "left_anti").select("node", "digest", "n").unionByName(hash_leaves(inside, depth))


def grade_counts(relevance: DataFrame) -> DataFrame:
    """(grade, judgements)."""
    return relevance.groupBy("grade").agg(F.count("*").alias("judgements"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status): added, removed or changed (by SHA-256) notes."""
    a, b = (t.select("path", F.sha2("text", 256).alias(n)) for t, n in ((before, "a"), (after, "b")))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full").select("path", status.alias("status")).where("status is not null")


def diagnostics(notes: DataFrame, chunks: DataFrame, postings: DataFrame, version: str) -> DataFrame:
    """One row of a version and counts, without content."""
    known = notes.agg(F.count("*").alias("notes"), F.coalesce(F.sum(F.when(F.octet_length("text") > 1048576, 1).otherwise(0)), F.lit(0)).cast("long").alias("skipped"))
    made = chunks.agg(F.countDistinct("path").alias("indexed"), F.count("*").alias("chunks"))
    terms = postings.agg(F.count("*").alias("postings"))
    rows = [t.withColumn("_k", F.lit(1)) for t in (known, made, terms)]  # one row each
    return rows[0].join(rows[1], "_k").join(rows[2], "_k").drop("_k").withColumn("version", F.lit(version))
