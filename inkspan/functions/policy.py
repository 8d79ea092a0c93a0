"""Which notes may be indexed or sent: columns only, so Spark can push what it can to the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest note, in UTF-8 bytes.
MAX_BYTES = 1024 * 1024


def normalize_path(path: Column) -> Column:
    """Lower-cased path with ``/`` only, without empty, ``.`` and ``..`` parts; null if it leaves the root."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("bad"))

    def step(state: Column, part: Column) -> Column:
        depth = F.size(state["parts"])
        up = F.struct(F.slice(state["parts"], 1, F.greatest(depth - 1, F.lit(0))).alias("parts"), (state["bad"] | (depth == 0)).alias("bad"))
        down = F.struct(F.concat(state["parts"], F.array(F.lower(part))).alias("parts"), state["bad"].alias("bad"))
        return F.when(part.isin("", "."), state).when(part == "..", up).otherwise(down)

    return F.aggregate(F.split(F.translate(path, "\\", "/"), "/"), start, step, lambda s: F.when(~s["bad"], F.array_join(s["parts"], "/")))


def within(value: Column, parent: Column) -> Column:
    return (value == parent) | F.startswith(value, F.concat(parent, F.lit("/")))


def normalize_tag(tag: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(tag, r"^\s+|\s+$", ""), "^#+", ""), "/+$", ""))


def hidden(normalized: Column) -> Column:
    """Whether a folder on the way (not the file itself) starts with a point."""
    parts = F.split(normalized, "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.startswith(p, F.lit(".")))


def is_excluded(path: Column, tags: Column, folders: Column, excluded_tags: Column, config_dir: Column) -> Column:
    """Whether policy withholds a note; all list arguments are array columns."""
    normalized = normalize_path(path)
    parents = F.transform(F.filter(F.concat(F.array(config_dir), folders), lambda f: F.trim(f) != ""), lambda f: normalize_path(F.trim(f)))
    in_folder = F.exists(parents, lambda p: p.isNotNull() & ((p == "") | within(normalized, p)))
    banned = F.filter(F.transform(excluded_tags, normalize_tag), lambda t: t != "")
    tagged = F.exists(banned, lambda e: F.exists(F.transform(F.coalesce(tags, F.array().cast("array<string>")), normalize_tag), lambda t: within(t, e)))
    return normalized.isNull() | F.coalesce(hidden(normalized), F.lit(False)) | F.coalesce(in_folder, F.lit(False)) | F.coalesce(tagged, F.lit(False))


def texts(values: list[str]) -> Column:
    """A list of literals as an array column."""
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def eligible(path: Column, size: Column, folders: Column, config_dir: Column, most: int = MAX_BYTES) -> Column:
    """Markdown, not beyond ``most`` bytes and not in an excluded folder; needs no content."""
    none = F.array().cast("array<string>")
    return F.lower(path).endswith(".md") & (size <= most) & ~is_excluded(path, none, folders, none, config_dir)


def allowed(path: Column, size: Column, tags: Column, folders: Column, excluded_tags: Column, config_dir: Column) -> Column:
    """Eligible, with known tags (null: metadata not ready) of which none is excluded."""
    return eligible(path, size, folders, config_dir) & tags.isNotNull() & ~is_excluded(path, tags, folders, excluded_tags, config_dir)
