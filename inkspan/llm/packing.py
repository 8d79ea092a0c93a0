"""Best-fit packing planned on a histogram of lengths.

1. Every text is tokenized once and cut into pieces of at most ``capacity`` tokens; only documents
   longer than that are cut.
2. Piece lengths are counted (``capacity`` counters at most, whatever the corpus) and best-fit
   decreasing runs over the counts: a step places all pieces of one length that fit the
   fullest fitting group of equal sequences. The plan is a list of slot runs, bounded by the
   number of lengths and not by the number of documents.
3. Pieces get a rank within their length by one range shuffle of narrow rows and look up their
   slot run by (length, rank).

Tokenizing words: white space ends a pre-token of this tokenizer, so each word's ids are cached as bytes and a
document's ids are the words' bytes joined. Words outside plain Latin script, or with a special
token's text, are encoded whole by the tokenizer; texts with the separators U+001C..U+001F, which Python and
the tokenizer treat differently, are encoded whole. Caches are bounded and only affect speed.

Defined cases: a null or empty text is one piece that holds the end token alone; null doc_ids
and repeated rows are packed as any row; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import ordered_positions, read_table, stage
from inkspan.llm.textscan import slices

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Cached words and pre-tokens of one Python worker.
WORD_CACHE, PIECE_CACHE = 400_000, 700_000

_PLAIN = re.compile("[\x21-\x7e\xa1-ſ]+").fullmatch
_ODD_SPACE = re.compile("[\x1c-\x1f]").search


#: Byte-level models show a byte as the character of its number if that is printable, else as the next free one from U+0100.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_SHOWN = {b: chr(256 + k) for k, b in enumerate(_HIDDEN)}


class WordEncoder:
    """Token ids of whole texts as little-endian uint32 bytes."""

    def __init__(self, tokenizer_json: str):
        import regex
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        #: The tokenizer's own pre-token pattern.
        self._pretokens = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self._words: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _parts(self, word: str) -> tuple[str, ...] | None:
        """Pre-tokens of a word in plain Latin script; None for others."""
        low = word.lower()
        if not low.isascii() and not (_PLAIN(word) and unicodedata.is_normalized("NFC", word)):
            return None
        if low.isalpha():
            return (low,)
        core = low.rstrip(".,")
        if core.isalpha():  # the points and commas behind it are one pre-token
            return (core, low[len(core) :])
        if "<|" in word or not _PLAIN(word):
            return None
        return tuple(self._pretokens(low))

    def _learn(self, words: set[str]) -> None:
        split, pieces = {}, self._pieces
        for word in words:
            parts = self._parts(word)
            if parts is None:
                self._words[word] = self._whole(word)
            else:
                split[word] = parts
        tokenize = self._tokenizer.model.tokenize
        for piece in {p for parts in split.values() for p in parts if p not in pieces}:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_SHOWN)
            pieces[piece] = array("I", [t.id for t in tokenize(shown)]).tobytes()
        for word, parts in split.items():
            self._words[word] = pieces[parts[0]] if len(parts) == 1 else b"".join([pieces[p] for p in parts])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self._words) > WORD_CACHE:
            self._words.clear()
        if len(self._pieces) > PIECE_CACHE:
            self._pieces.clear()
        known, out, open_, new = self._words, [], [], set()
        for text in texts:
            if not text or _ODD_SPACE(text):
                out.append(self._whole(text) if text else b"")
                continue
            words = text.split()
            ids = list(map(known.get, words))
            if None in ids:
                open_.append((len(out), words, ids))
                new.update([w for w, i in zip(words, ids, strict=True) if i is None])
                out.append(b"")
            else:
                out.append(b"".join(ids))
        self._learn(new)
        for place, words, ids in open_:
            out[place] = b"".join([known[w] if i is None else i for w, i in zip(words, ids, strict=True)])
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder_of(tokenizer_json: str) -> WordEncoder:
    """The worker's encoder; a reused Python worker keeps its caches from task to task."""
    if tokenizer_json not in _encoders:
        _encoders.clear()
        _encoders[tokenizer_json] = WordEncoder(tokenizer_json)
    return _encoders[tokenizer_json]


def pieces(docs: DataFrame, tokenizer_json: str, capacity: int, end_id: int) -> DataFrame:
    """One row for each piece of each document, with the checksum of its ids."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_json)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):  # ids and new words of a slice are held at once
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for k, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                columns = list(zip(*rows, strict=True))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slot runs (length, first rank, items in a sequence, first sequence, offset) of best-fit decreasing over counts.

    Groups of equal sequences are kept by the room they have left. The pieces of a length go to the
    group with the least room that takes them; a group that only some of them fill is split.
    """
    rooms: list[int] = []  # sorted, those with groups
    groups: dict[int, list[tuple[int, tuple]]] = {}  # room -> (sequences, placed runs (length, items, offset))
    closed: list[tuple[int, tuple]] = []

    def put(room: int, sequences: int, runs: tuple) -> None:
        if room == 0:
            closed.append((sequences, runs))
            return
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((sequences, runs))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                sequences, runs = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, runs = capacity, ()
                sequences = -(-left // (capacity // length))
            each = room // length
            filled = min(sequences, left // each)
            offset = capacity - room
            if filled:
                put(room - each * length, filled, (runs, (length, each, offset)))
                left -= filled * each
            if filled < sequences:
                rest = sequences - filled
                if left and left < each:
                    put(room - left * length, 1, (runs, (length, left, offset)))
                    left, rest = 0, rest - 1
                if rest:
                    put(room, rest, runs)
    out, next_rank, sequence = [], {n: 0 for n in counts}, 0
    for count, runs in closed + [g for room in rooms for g in groups[room]]:
        while runs:
            runs, (length, each, offset) = runs
            out.append((length, next_rank[length], each, sequence, offset))
            next_rank[length] += count * each
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with sequence_id and offset."""
    cut = stage(pieces(docs, tokenizer_json, capacity, end_id))
    # one row for each length: ``capacity`` rows at most
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = sorted(best_fit_plan(counts, capacity))
    lengths = np.array([p[0] for p in plan], dtype=np.int64)
    first_of = np.zeros(capacity + 1, dtype=np.int64)
    before = 0
    for length in sorted(counts):
        first_of[length], before = before, before + counts[length]
    starts = first_of[lengths] + np.array([p[1] for p in plan], dtype=np.int64)
    each, sequence, offset = (np.array([p[k] for p in plan], dtype=np.int64) for k in (2, 3, 4))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, length = (batch.column(k).to_numpy() for k in (5, 3))
            run = np.searchsorted(starts, pos, side="right") - 1
            k = pos - starts[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[run] + k // each[run]), pa.array(offset[run] + k % each[run] * length)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    placed = ordered_positions(cut, ["length", "doc_id", "piece", "ids_crc32"], "_pos")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_pos").mapInArrow(place, PIECE_SCHEMA + ", sequence_id long, offset long")


def tokenizer_text(path: str | None = None) -> str:
    """The tokenizer's definition, read on the driver; executors get its text."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_text())
