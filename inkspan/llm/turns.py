"""Repair of conversation structure: the cheapest edits that make a conversation alternate.

Wanted are role initials ``(s?(ua)+)?``. A turn may be kept (K, 0), given the role user or assistant (R, 3) or deleted (D, 4);
blank and repeated turns must be deleted; a truncated turn that stays costs 3 more; turns without text may be inserted anywhere (I, 3).
Of equally cheap edits those count whose initials are the least string.

1. All turns are sorted by conversation and turn and numbered (one range shuffle), so a conversation of any length is spread over tasks.
2. ``SEGMENT`` numbers are a segment, cut at the ends of conversations too; ``BATCH`` numbers are a batch, hashed to a task. In each batch a
   recursive DuckDB query advances one turn for all segments at once and keeps the least (cost, edits) of each grammar state. A segment
   that may begin within a conversation is computed from every state. No audit can begin another one of the same cost, as they differ in
   insertions then, so least prefixes make least wholes and segments can be composed.
3. The same recursion over the segments of each conversation, in batches of conversations, composes them and adds up the faults.
4. The chosen edits join their turns in one sorted pass, which gives the repaired turns; digests read these row by row.

What is one cell of the result, the audit of a conversation, is built in one task; its texts are only streamed past a SHA-256, which has no
parallel form.

Defined cases: null role, text, turn and conv_id (a conversation of its own) count as one space in strings, a null turn comes first; turns
of one number go by role and text; rows that repeat are duplicates; texts are taken whole, whatever their length; role initials go by
case, turns of other ones than s, u and a, or of an empty role, are never kept; a conversation without rows needs no edits; a gap count beyond a long is null; an empty
table gives an empty result; further columns are ignored, whatever their names. Equal texts are told by MD5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import lookup_join, ordered_positions, read_table, stage

SEGMENT, BATCH = 128, 32_768
#: What counts as white space, and the ends of a sentence.
SPACE, ENDS = "\x20\x09\x0a\x0b\x0c\x0d", ".!?"
KEEP, RETAG, DELETE, INSERT, CUT = 0, 3, 4, 3, 3

#: Grammar states: nothing yet, after s, after u, after a. What may follow each of them.
_FOLLOWS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
#: What a turn's edits are called in a path: a letter of the audit that also tells the role.
_AUDIT = {"k": "K", "U": "R", "A": "R", "d": "D", "u": "I", "a": "I"}
_ROLES = {"u": "user", "a": "assistant"}


@cache
def moves() -> tuple[list[tuple], list[tuple]]:
    """(kind, from, to, cost, audit, path) of a turn with the insertions before it, and the same without kind of the end.

    The kind of a turn is its initial (or ``-``) and ``.`` (sound), ``~`` (truncated) or ``x`` (must go).
    """

    def insertions(state: int) -> list[tuple[int, int, str]]:
        out = [(state, 0, "")]
        for _ in range(2):  # a third one would come back to the state of the first
            at, cost, path = out[-1]
            role = "a" if at == 2 else "u"
            out.append((_FOLLOWS[at][role], cost + INSERT, path + role))
        return out

    def audit(path: str) -> str:
        return "".join(_AUDIT[c] for c in path)

    best: dict[tuple, tuple] = {}
    for kind in (i + f for i in "sua-" for f in ".~x"):
        for start in range(4):
            for at, cost, path in insertions(start):
                edits = [(at, DELETE, "d")]
                if kind[1] != "x":
                    extra = CUT if kind[1] == "~" else 0
                    edits += [(to, KEEP + extra, "k") for role, to in _FOLLOWS[at].items() if role == kind[0]]
                    edits += [(to, RETAG + extra, role.upper()) for role, to in _FOLLOWS[at].items() if role in _ROLES]
                for to, more, edit in edits:
                    found = (cost + more, audit(path + edit), path + edit)
                    best[kind, start, to] = min(best.get((kind, start, to), found), found)
    ends = [(start, cost, audit(path), path) for start in range(4) for at, cost, path in insertions(start) if at == 3 or at == 0]
    return [(*k, *v) for k, v in best.items()], ends


def _session(**tables: pa.Table):
    import duckdb

    db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
    for name, rows, columns in (("moves", moves()[0], "kind p q cost audit path"), ("ends", moves()[1], "p cost audit path")):
        db.register(name, pa.table(dict(zip(columns.split(), map(list, zip(*rows, strict=True)), strict=True))))
    for name, table in tables.items():
        db.register(name, table)
    return db


_SEGMENTS = f"""
WITH RECURSIVE
heads AS (SELECT conv, seg, min(pos) AS lo, count(*) AS n FROM turns GROUP BY conv, seg),
numbered AS (SELECT conv, seg, pos - lo AS k, kind FROM turns JOIN heads USING (conv, seg)),
best AS (
  SELECT conv, seg, 0::BIGINT AS k, s AS start, s AS p, {{'cost': 0::BIGINT, 'audit': '', 'path': ''}} AS b
  FROM heads, unnest(CASE WHEN lo % {SEGMENT} = 0 THEN [0, 1, 2, 3] ELSE [0] END) AS starts(s)
  UNION ALL
  SELECT conv, seg, k + 1, start, q, min({{'cost': b.cost + m.cost, 'audit': b.audit || m.audit, 'path': b.path || m.path}})
  FROM best JOIN numbered USING (conv, seg, k) JOIN moves m ON m.kind = numbered.kind AND m.p = best.p
  GROUP BY conv, seg, k, start, q),
done AS (SELECT conv, seg, list({{'s': start, 'e': p, 'cost': b.cost, 'audit': b.audit, 'path': b.path}}) AS paths FROM best JOIN heads USING (conv, seg) WHERE k = n GROUP BY conv, seg),
paired AS (SELECT *, lag(initial) OVER (PARTITION BY conv, seg ORDER BY pos) AS before FROM turns),
facts AS (
  SELECT conv, seg, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, arg_min(initial, pos) AS first, arg_max(initial, pos) AS last,
    min(turn) AS turn_min, max(turn) AS turn_max, count(DISTINCT turn) AS turns
  FROM paired GROUP BY conv, seg)
SELECT conv, seg, lo, blank, duplicate, truncated, illegal, first, last, turn_min, turn_max, turns, paths FROM heads JOIN done USING (conv, seg) JOIN facts USING (conv, seg)
"""

#: Segments of a conversation adjoin; equal turns on both sides of a border are one.
_WHOLES = """
WITH RECURSIVE
numbered AS (SELECT *, row_number() OVER w - 1 AS i, lag(last) OVER w AS before, lag(turn_max) OVER w AS turn_before FROM segments WINDOW w AS (PARTITION BY conv ORDER BY seg)),
steps AS (SELECT conv, i, unnest(paths, recursive := true) FROM numbered),
best AS (
  SELECT conv, 0::BIGINT AS i, 0 AS p, {'cost': 0::BIGINT, 'audit': '', 'path': ''} AS b FROM numbered WHERE i = 0
  UNION ALL
  SELECT conv, i + 1, e, min({'cost': b.cost + s.cost, 'audit': b.audit || s.audit, 'path': b.path || s.path})
  FROM best JOIN steps s USING (conv, i) WHERE s.s = best.p GROUP BY conv, i, e),
facts AS (
  SELECT conv, min(lo) AS lo, count(*) AS n, sum(blank) AS blank, sum(duplicate) AS duplicate, sum(truncated) AS truncated,
    sum(illegal) + count(*) FILTER (before || first NOT IN ('su', 'ua', 'au')) AS illegal,
    coalesce(max(turn_max)::HUGEINT - min(turn_min) + 1 - (sum(turns) - count(*) FILTER (turn_before = turn_min)), 0) AS gaps
  FROM numbered GROUP BY conv),
chosen AS (SELECT conv, min({'cost': b.cost + x.cost, 'audit': b.audit || x.audit, 'path': b.path || x.path}) AS b FROM best JOIN facts USING (conv) JOIN ends x ON x.p = best.p WHERE i = n GROUP BY conv)
SELECT conv, lo, try_cast(gaps AS BIGINT) AS gaps, blank::BIGINT AS blank, duplicate::BIGINT AS duplicate, truncated::BIGINT AS truncated, illegal::BIGINT AS illegal, b.cost AS cost, b.audit AS audit, b.path AS path
FROM facts JOIN chosen USING (conv)
"""


def _segments(turns: pa.Table) -> pa.Table:
    with _session(turns=turns) as db:
        return db.sql(_SEGMENTS).to_arrow_table()


def _wholes(segments: pa.Table) -> pa.Table:
    with _session(segments=segments) as db:
        return db.sql(_WHOLES).to_arrow_table()


_SEGMENT_ROW = "conv string, seg long, lo long, blank long, duplicate long, truncated long, illegal long, first string, last string, turn_min long, turn_max long, turns long, paths array<struct<s int, e int, cost long, audit string, path string>>"
_WHOLE_ROW = "conv string, lo long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, path string"


def _text(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows dropped, emptied, truncated, repeated or given the role user by the CRC-32 of ``conv_id:turn``."""
    rows = conversations.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"))
    kind = F.crc32(F.concat_ws(":", _text("conv_id"), _text("turn")).cast("binary")) % 20
    rows = rows.withColumn("_kind", kind).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def conversation_key() -> Column:
    """A string that names a conversation, a null one too."""
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("-"))


def numbered(turns: DataFrame) -> DataFrame:
    """The turns in order, staged: conv, conv_id, turn, role, text and pos, a number over all of them."""
    rows = turns.select(conversation_key().alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"))
    return stage(ordered_positions(rows, ["conv", "turn", "role", "text"], "pos"))


def plans(ordered: DataFrame) -> DataFrame:
    """One staged row a conversation: counts of faults, gaps, cost, audit and path (edits with roles) of its cheapest repair."""
    said = F.concat_ws(":", F.length("conv"), "conv", F.length("role"), "role", "text")
    shown = F.rtrim(F.col("text"), F.lit(SPACE))
    narrow = ordered.select("conv", "pos", "turn", F.substring("role", 1, 1).alias("initial"), F.md5(said.cast("binary")).alias("said"), F.when(shown == "", 1).when(~F.right(shown, F.lit(1)).isin(*ENDS), 3).otherwise(0).alias("fault"))
    again = stage(narrow.groupBy("said").agg(F.count("*").alias("n"), F.min("pos").alias("once")).where("n > 1").select("said", "once"))
    narrow = lookup_join(narrow, again, ["said"], "left").withColumn("fault", F.when((F.col("fault") != 1) & (F.col("pos") > F.col("once")), 2).otherwise(F.col("fault")))
    usual = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("-")
    mark = F.when(F.col("fault") == 0, ".").when(F.col("fault") == 3, "~").otherwise("x")
    rows = narrow.select("conv", F.expr(f"pos div {SEGMENT}").alias("seg"), F.expr(f"pos div {BATCH}").alias("batch"), "pos", "turn", "initial", "fault", F.concat(usual, mark).alias("kind"))
    parts = stage(rows.groupBy("batch").applyInArrow(_segments, _SEGMENT_ROW))
    batches = max(1, parts.count() * 4 // BATCH)
    return stage(parts.groupBy(F.pmod(F.xxhash64("conv"), F.lit(batches)).alias("batch")).applyInArrow(_wholes, _WHOLE_ROW))


_REPAIRED = pa.schema([("conv", pa.string()), ("turn", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns (sorted, each after its edits) as they are after the edits, with their place; deleted ones stay with the edit D and no place."""
    last, place, edit = None, 0, None
    for batch in batches:
        out: list[tuple] = []
        for conv, turn, role, text, path in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "path")), strict=True):
            if conv != last:
                last, place = conv, 0
            if path is None:
                out.append((conv, turn, None if edit == "d" else place, _AUDIT[edit], _ROLES.get(edit.lower(), role), text))
                place += edit != "d"
                continue
            own = path[-1] in "kUAd"
            edit = path[-1] if own else None
            for c in path[:-1] if own else path:
                out.append((conv, None, place, "I", _ROLES[c], ""))
                place += 1
        columns = zip(*out, strict=True) if out else [[]] * len(_REPAIRED)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _REPAIRED, strict=True)], schema=_REPAIRED)


def apply_plans(ordered: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv, turn, place, edit, role, text) of every turn and insertion; each task holds whole conversations, in order."""
    edit = F.posexplode(F.regexp_extract_all("path", F.lit("[ua]*[dkUA]|[ua]+$"), F.lit(0))).alias("k", "path")
    edits = chosen.select("conv", "lo", edit).select("conv", (F.col("lo") + F.col("k")).alias("pos"), F.lit(None).cast("long").alias("turn"), *(F.lit(None).cast("string").alias(c) for c in ("role", "text")), "path")
    rows = edits.unionByName(ordered.select("conv", "pos", "turn", "role", "text", F.lit(None).cast("string").alias("path")))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "pos", F.col("path").asc_nulls_last())
    return rows.mapInArrow(_edit, "conv string, turn long, place long, edit string, role string, text string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of ``role:text`` lines of each conversation; a text passes once and is not kept."""
    conv, state, begun = None, None, False
    for batch in batches:
        done = []
        for now, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "edit", "role", "text")), strict=True):
            if now != conv:
                if conv is not None:
                    done.append((conv, state.hexdigest()))
                conv, state, begun = now, hashlib.sha256(), False
            if edit != "D":
                state.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                begun = True
        yield pa.RecordBatch.from_pydict({"conv": [c for c, _ in done], "repaired_sha256": [d for _, d in done]}, pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())]))
    if conv is not None:
        yield pa.RecordBatch.from_pydict({"conv": [conv], "repaired_sha256": [state.hexdigest()]})


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, place, edit, role, text): the turns after the cheapest repair; edit is K, R, I, or D for what goes (it has no place)."""
    ordered = numbered(turns)
    ids = ordered.groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    return apply_plans(ordered, plans(ordered)).join(ids, "conv").select("conv_id", "turn", "place", "edit", "role", "text")


def report(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``: what ails its ``turns``, cost and audit of the repair, digest of the repaired text."""
    ordered = numbered(turns)
    chosen = plans(ordered)
    digests = apply_plans(ordered, chosen).mapInArrow(_digest, "conv string, repaired_sha256 string")
    ids = conversations.groupBy("conv_id").agg(F.lit(1).alias("_one")).select(conversation_key().alias("conv"), "conv_id")
    out = ids.join(chosen.drop("lo", "path"), "conv", "left").join(digests, "conv", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.when(F.col("cost").isNull(), F.lit(0).cast("long")).otherwise(F.col("gaps")).alias("gaps")
    return out.select("conv_id", gaps, *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    return report(damage(conversations), conversations)
