"""Tokens, weights, hashes and other scalar functions of text."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Tokenizer = Callable[[Column], Column]

#: Marks and weights of whole-word and single-character tokens.
WORD_PREFIX, CHAR_PREFIX = "w:", "c:"
WORD_WEIGHT, CHAR_WEIGHT = 1.2, 0.5

#: Characters that NFKC leaves as they are, alone and in sequence (no combining marks among them).
_STABLE = "^[\x01-\x7f¡-§©«-®°±¶·»¿-ıĴ-ľŁ-ňŊ-žƀ-ǃぁ-ゖァ-ヺー一-\u9fff]*$"
#: Full-width forms and the characters that NFKC puts in their place, one for one.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)
_BELOW_CJK = "\\x00-\\u2e7f"
_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー"
#: What trimming takes off: Unicode spaces, line ends and the byte order mark.
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def is_stable(text: Column) -> Column:
    """Whether NFKC surely changes nothing."""
    return text.rlike(_STABLE)


def all_stable(df: DataFrame, *names: str) -> bool:
    """One look at the data: when true, plans need no Python for normalization."""
    unstable = F.lit(False)
    for name in names:
        unstable = unstable | ~F.coalesce(is_stable(F.col(name)), F.lit(True))
    return df.where(unstable).select(F.lit(1)).limit(1).isEmpty()


def fold(text: Column, stable: bool = False) -> Column:
    """NFKC and lower case; with ``stable`` the former is skipped. Only rows that need it send their text to Python."""
    if stable:
        return F.lower(text)
    plain = narrowed(text)
    return F.lower(F.coalesce(_nfkc(F.when(~is_stable(plain), plain)), plain))


def narrowed(text: Column) -> Column:
    """Full-width forms as the characters that they stand for; NFKC of the result is that of the text."""
    # an array of one, so that the text is made once
    return F.get(F.transform(F.array(text), lambda t: F.when(t.rlike("[！-～]"), F.translate(t, _WIDE, _NARROW)).otherwise(t)), F.lit(0))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def runs(folded: Column) -> Column:
    """Maximal runs of ``[a-z0-9_]`` or of Han, Hiragana and Katakana."""
    return _all(folded, rf"[a-z0-9_]+|[{_CJK}]+")


def bigrams(run: Column) -> Column:
    """Overlapping pairs of characters; a single character is itself."""
    return F.when(F.length(run) < 2, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))


def _marked(values: Column, prefix: str) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(prefix), v))


def _cjk_tokens(run: Column) -> Column:
    return F.concat(bigrams(run), _marked(_all(run, r"[\p{IsKatakana}ー]{2,}"), WORD_PREFIX), _marked(_all(run, r"\p{IsHan}{2,8}"), WORD_PREFIX), _marked(_all(run, r"\p{IsHan}"), CHAR_PREFIX))


def tokens(folded: Column) -> Column:
    """The bag of tokens of folded text: words of Latin runs; bigrams, words and characters of others.

    Han, Hiragana and Katakana all lie beyond ``_BELOW_CJK``; a text without such characters is not asked for their scripts one by one.
    """
    mixed = F.flatten(F.transform(runs(folded), lambda r: F.when(r.rlike("^[a-z0-9_]"), F.array(r)).otherwise(_cjk_tokens(r))))
    return F.when(folded.rlike(f"[^{_BELOW_CJK}]"), mixed).otherwise(_all(folded, "[a-z0-9_]+"))


def bigram_tokens(folded: Column) -> Column:
    """The baseline: words of Latin runs and bigrams of others."""
    return F.flatten(F.transform(runs(folded), lambda r: F.when(r.rlike("^[a-z0-9_]"), F.array(r)).otherwise(bigrams(r))))


def katakana_tokens(least: int) -> Tokenizer:
    """The baseline and, marked ``K:``, Katakana runs of at least so many characters."""
    return lambda folded: F.concat(bigram_tokens(folded), _marked(_all(folded, rf"[\p{{IsKatakana}}ー]{{{least},}}"), "K:"))


TOKENIZERS: dict[str, Tokenizer] = {"shipped": tokens, "bigram": bigram_tokens, "katakana2": katakana_tokens(2), "katakana3": katakana_tokens(3)}


def token_weight(term: Column) -> Column:
    return F.when(F.startswith(term, F.lit(WORD_PREFIX)), WORD_WEIGHT).when(F.startswith(term, F.lit(CHAR_PREFIX)), CHAR_WEIGHT).otherwise(1.0)


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACES}]")


def fnv_hashes(texts: list[str]) -> list[str]:
    """32-bit FNV-1a over UTF-16 units, as 8 hex digits; all texts advance together, one unit a step."""
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), dtype="<u2") for t in texts]
    order = np.argsort([-len(u) for u in units], kind="stable")
    state = np.full(len(units), 0x811C9DC5, dtype=np.uint64)
    table = np.zeros((max(map(len, units), default=0), len(units)), dtype=np.uint64)
    for place, k in enumerate(order):
        table[: len(units[k]), place] = units[k]
    sizes = np.array([len(units[k]) for k in order])
    for at in range(len(table)):
        n = int(np.searchsorted(-sizes, -at, side="left"))
        state[:n] = ((state[:n] ^ table[at, :n]) * np.uint64(0x01000193)) & np.uint64(0xFFFFFFFF)
    out = [""] * len(units)
    for place, k in enumerate(order):
        out[k] = f"{int(state[place]):08x}"
    return out


@F.pandas_udf(StringType())
def content_hash(text: pd.Series) -> pd.Series:
    known = text.fillna("")
    return pd.Series(fnv_hashes(known.tolist()), index=text.index)


@F.pandas_udf(StringType())
def chunk_id(path: pd.Series, start_line: pd.Series, ordinal: pd.Series, digest: pd.Series) -> pd.Series:
    """``[path, start line, ordinal, hash]`` as compact JSON."""
    rows = zip(path, start_line, ordinal, digest, strict=True)
    return pd.Series([json.dumps([p, int(s), int(o), h], ensure_ascii=False, separators=(",", ":")) for p, s, o, h in rows], index=path.index)


def clip(text: Column, points: int) -> Column:
    return F.substring(text, 1, points)


def excerpt(text: Column) -> Column:
    return F.left(text, F.lit(240))


def safe_name(name: Column) -> Column:
    """A title as a file name."""
    return F.left(F.regexp_replace(name, r'[\\/:*?"<>|#^\[\]]', "_"), F.lit(120))


def pick_sentence(text: Column, title: Column, number: Column) -> Column:
    """One sentence of 15 to 90 characters without the title, chosen by ``number``; null if there is none."""
    fit = F.filter(F.transform(F.split(text, "。"), lambda s: F.trim(s)), lambda s: F.length(s).between(15, 90) & ~F.contains(s, title))
    return F.when(F.size(fit) > 0, F.get(fit, F.pmod(number, F.size(fit)).cast("int")))


def preview_cost(body_bytes: Column, price: float) -> Column:
    """What a request may cost, from its bytes (a token has one at least) and the price of a million tokens, to six decimals."""
    return F.round(body_bytes * F.lit(price) / 1e6, 6)


def cost_text(cost: Column, tokens_used: Column, price: float) -> Column:
    """The charged cost, or the one that follows from tokens and the price of a million, to six decimals; else ``unknown``."""
    known = F.coalesce(cost, tokens_used * F.lit(price) / 1e6)
    return F.when(known.isNotNull(), F.format_string("$%.6f", known)).otherwise("unknown")
