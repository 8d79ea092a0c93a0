"""Secret scans with a random forest against false positives. DataFrame operations only.

Candidates, found anywhere in whole texts in one pass, are (1) what is given to a name with a secret word in it, by ``=``, ``:``, ``=>`` or ``is``,
also behind ``Bearer`` and the like: four and more characters but white space, quotes and brackets, and commas and semicolons only
within; (2) the password of an address (``name:password@``); (3) signed tokens of parts joined by dots; (4) runs of 12 and more letters,
digits, ``+ / _ -`` (and up to two ``=`` at the end) with a digit or with two changes between lower and upper case. Only ASCII letters and
digits bound a run, so a key within Chinese or Japanese text counts. Each comes with the 40 characters before and 20 after it. Features: length, character transitions, shares of character classes, distinct
characters, longest runs, dictionary coverage, path marks and neighbouring words. The forest is trained from labelled findings:
``FINDINGS`` of them, made from a seed by the rules in ``labelled_findings`` (keys, tokens, passwords and passphrases in their
usual places against identifiers, hashes, paths, dates, placeholders, ordinary words and calls), since no table labels
secrets. Their features come from the same DataFrame expressions; the trees are grown on the driver and become one SQL
expression, so scoring is a projection without Python.

Rows of the result: one for each candidate, with its number within the text, score (mean of the trees) and
``secret`` (score of at least 0.5).

Defined cases: null and empty texts have no candidates; null doc_ids and repeated rows give their findings as any row;
texts of any length are scanned whole; findings of a text are numbered in order, so there are no ties; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import json
import random
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import read_table

FINDINGS = 4000
TREES, DEPTH = 21, 6
SECRET = 0.5

#: Words beside a secret, and words beside other long identifiers.
SECRET_WORDS = "pass(?:word|wd|phrase)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|credential|auth|bearer|private"
OTHER_WORDS = "commit|sha(?:1|256|512)?|md5|checksum|digest|uuid|guid|etag|revision|version|isbn|order|invoice|href|src|url|http"

#: The secret words again, by their first letters, as this is tried at every letter of every text.
_WORD = r"(?=[pPsStTaAcCbB])(?i:p(?:ass|wd|rivate)|secret|token|a(?:uth|pi[_ -]?key|ccess[_ -]?key)|credential|bearer)"
_NAME = rf"{_WORD}[A-Za-z0-9_-]{{0,20}}[\"']?"
_GIVEN = r"\s{0,3}(?:=>|:=|[:=]|\s(?i:is|was)\s)\s{0,3}[\"'(\[{<`]?(?:(?i:bearer|basic|digest|token)\s{1,3})?"
_OPEN, _INNER = r"[^\s\"'`<>(){}\[\],;:=]", r"(?:[^\s\"'`<>(){}\[\],;]|[,;](?=[^\s\"'`<>(){}\[\],;]))"
_VALUE = rf"((?:{_NAME}{_GIVEN}|(?<![A-Za-z])(?i:bearer)\s{{1,3}}))({_OPEN}{_INNER}{{3,}})"
_ADDRESS = r"(://[^\s:/@\"'<>]{1,64}:)([^\s@/\"'<>]{3,})(?=@)"
_SIGNED = r"(?<![A-Za-z0-9._-])eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{4,}){1,2}"
#: Twelve characters are asked for first, as most runs have fewer; a name that is given a value is none.
_PLAIN = (
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{12})(?=[A-Za-z+/_-]*(?:[0-9]|[a-z][A-Z][A-Za-z+/_-]*[a-z][A-Z]))"
    rf"(?![A-Za-z0-9_-]{{0,40}}?{_NAME}{_GIVEN}{_OPEN})[A-Za-z0-9+/_-]{{12,}}+={{0,2}}(?![A-Za-z0-9])"
)
#: Groups 1 and 3 are what stands before a candidate, 2, 4 and 5 are candidates.
_CANDIDATE = rf"{_VALUE}|{_ADDRESS}|({_SIGNED}|{_PLAIN})"
#: Sets candidates off from the text around them; in texts it counts as a space.
_EDGE = "\x01"
BEFORE, AFTER = 40, 20
#: Parts of a text that hold the characters after a candidate: four of them are candidates, of at least three characters and an edge.
_FOLLOWING = 16

#: Words that long runs of ordinary text are made of.
DICTIONARY = (
    "about account address admin after agent alpha application archive article assets back background backup banner "
    "base beta block blog body book bottom branch bucket build button cache camera case center change chapter client "
    "cloud code color common company config container content control copy core country create current custom "
    "daily data date default demo design detail device digital document domain download draft drive edit email "
    "engine entry error event example export feature field file filter final folder footer form frame front "
    "function gallery game general global graph group guide header health help history home host house icon image "
    "import index info input install item journal language large layout left level library line link list local "
    "location login main manager master media member menu message mobile model module month name network news note "
    "number object office option order output package page panel paper part path people photo picture place plan "
    "player plugin point post preview price print product profile program project public query question queue random "
    "range rate reader record region release remote report request required reset resource response result review "
    "right role room root route sample schema score screen script search section select server service session "
    "setting shared shop short side signal single site size small source space special sport staff stage standard "
    "start state static status step store story stream string style subject summary support system table target "
    "task team template test text theme thread thumb ticket time title today tool topic total track travel tree type "
    "unit update upload user value vendor version video view visit voice volume wall water week width window word work "
    "world writer year young zero zone"
).split()


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, finding, candidate, before, after) of every candidate of whole texts.

    One pass sets the candidates off; what stands before each is carried along the parts, so no position is counted from the start of a text.
    """
    text = F.translate(F.col("text").cast("string"), _EDGE, " ")
    parts = F.split(F.regexp_replace(text, F.lit(_CANDIDATE), F.lit(f"$1$3{_EDGE}$2$4$5{_EDGE}")), _EDGE)
    none = F.array().cast("array<struct<candidate:string,before:string,after:string>>")

    def found(parts: Column) -> Column:
        def step(state: Column, k: Column) -> Column:
            before = F.right(F.concat(state["tail"], F.get(parts, k - 1)), F.lit(BEFORE))
            after = F.left(F.array_join(F.transform(F.slice(parts, k + 2, F.lit(_FOLLOWING)), lambda p: F.left(p, F.lit(AFTER))), ""), F.lit(AFTER))
            own = F.get(parts, k)
            one = F.struct(own.alias("candidate"), before.alias("before"), after.alias("after"))
            return F.struct(F.right(F.concat(before, own), F.lit(BEFORE)).alias("tail"), F.concat(state["out"], F.array(one)).alias("out"))

        # candidates are the odd parts
        odd = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: k % 2 == 1)
        return F.aggregate(odd, F.struct(F.lit("").alias("tail"), none.alias("out")), step, lambda state: state["out"])

    rows = docs.select("doc_id", F.get(F.transform(F.array(parts), found), F.lit(0)).alias("_f"))
    return rows.select("doc_id", F.posexplode_outer("_f").alias("finding", "_c")).where("_c is not null").select("doc_id", "finding", "_c.candidate", "_c.before", "_c.after")


def features() -> dict[str, Column]:
    """Numeric features of (candidate, before, after)."""
    c, low = F.col("candidate"), F.lower("candidate")
    size = F.length(c)

    def share(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)) / size

    def longest(pattern: str) -> Column:
        return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit(f"({pattern}+)"), F.lit(1)), F.length)), F.lit(0))

    before, after = F.lower("before"), F.lower("after")
    changes = F.regexp_count(c, F.lit(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"))
    return {
        "size": size,
        "changes": changes / size,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "hexadecimal": share("[0-9a-fA-F]"),
        "vowels": share("[aeiouAEIOU]"),
        "marks": share("[/_-]"),
        "symbols": share("[^A-Za-z0-9/_+=-]"),
        "plain_word": low.rlike("^[a-z]+[.!?]?$").cast("int"),
        "call": (c.rlike(r"^(?:[a-z_]+\.)+[a-zA-Z_]+$|^\$|^%|^\*") | after.rlike(r"^\s*\(")).cast("int"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / size,
        "letter_run": longest("[A-Za-z]") / size,
        "lower_run": longest("[a-z]") / size,
        "digit_run": longest("[0-9]") / size,
        "repeats": F.regexp_count(c, F.lit(r"(.)(?=\1)")) / size,
        "dictionary": 1 - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / size,
        "slashes": F.regexp_count(c, F.lit("/")),
        "key_prefix": c.rlike("^(AKIA|ASIA|gh[pousr]_|sk_|sk-|xox|AIza|eyJ)").cast("int"),
        "dashes": F.regexp_count(c, F.lit("-")),
        "path": (before.rlike(r"[/\\.@]$|https?:|www\.") | after.rlike(r"^\.(html?|js|css|png|jpe?g|gif|svg|pdf|md|py|txt)\b|^[/@]")).cast("int"),
        "assigned": before.rlike(r"[=:]\s*[\"']?$").cast("int"),
        "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("int"),
        "secret_word": before.rlike(rf"(?<![a-z])({SECRET_WORDS})[a-z_-]*[\"']?\W{{0,6}}$").cast("int"),
        "secret_near": before.rlike(rf"(?<![a-z])({SECRET_WORDS})").cast("int"),
        "other_word": before.rlike(rf"({OTHER_WORDS})\W{{0,6}}$").cast("int"),
        "placeholder": low.rlike("example|sample|dummy|changeme|your|placeholder|xxxx|1234567|abcdef").cast("int"),
    }


def labelled_findings(count: int = FINDINGS, seed: int = 41) -> list[dict]:
    """Labelled findings made from a seed: secrets and false positives in equal number."""
    rng = random.Random(seed)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"

    def pick(alphabet: str, low: int, high: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))

    def words(n: int, glue: str) -> str:
        return glue.join(rng.choice([rng.choice(DICTIONARY), pick(letters, 3, 9)]) for _ in range(n))

    hexes, upper = digits + "abcdef", letters.upper()
    prose = lambda: " ".join(pick(letters, 2, 9) for _ in range(6)) + " "
    key = lambda: rng.choice(["password", "passwd", "token", "secret", "api_key", "api key", "auth_token", "access_key", "client_secret", "Authorization: Bearer"]) + rng.choice(["=", ": ", " = ", ' = "', '="', " => '", " is ", " "])
    secret = [
        lambda: ("AKIA" + pick(upper + digits[2:8], 16, 16), prose() + rng.choice(["", "key ", "aws_access_key_id = "])),
        lambda: (pick(hexes, 16, 64), prose() + key()),
        lambda: (base64.b64encode(rng.randbytes(rng.randint(12, 48))).decode(), prose() + key()),
        lambda: (pick(letters + upper + digits, 16, 48), prose() + key()),
        lambda: (rng.choice(["ghp_", "sk-", "sk_live_", "xoxb-", "AIza"]) + pick(letters + upper + digits, 20, 40), prose() + rng.choice(["", key()])),
        lambda: (pick(letters + digits, 3, 6) + pick(upper, 2, 4) + pick(digits + letters, 6, 16), prose() + key()),
        lambda: (pick(letters, 4, 8) + pick(digits, 1, 4) + pick("!@#$%&*?", 1, 2) + pick(letters + digits, 0, 4), prose() + key()),
        lambda: (pick(upper, 1, 1) + pick("@$!#", 1, 1) + pick(letters + digits, 4, 9) + pick("!?#" + digits, 1, 4), prose() + key()),
        lambda: (pick(letters + digits, 3, 5) + pick(upper + digits, 3, 5) + pick(digits, 1, 2), prose() + key()),
        lambda: ("".join(rng.choice([rng.choice(DICTIONARY), pick(letters, 4, 8)]) for _ in range(rng.randint(4, 5))), prose() + rng.choice(["password", "passphrase", "secret", "token"]) + rng.choice(["=", ": ", " = "])),
        lambda: ("eyJ" + ".".join(pick(letters + upper + digits, 12, 40) for _ in range(3)), prose() + rng.choice(["", key()])),
        lambda: (pick(letters, 2, 5) + pick("$!,;&" + digits, 1, 3) + pick(letters + upper + digits, 3, 8), rng.choice([prose() + key(), pick(letters, 5, 9) + "://" + pick(letters, 3, 6) + ":"])),
    ]
    other = [
        lambda: (rng.choice([*DICTIONARY, pick(letters, 6, 12)]).ljust(6, "s") + rng.choice(["", ".", "!"]), prose() + key()),
        lambda: (".".join(rng.choice(DICTIONARY) for _ in range(rng.randint(2, 3))), prose() + key()),
        lambda: (rng.choice(["$", "%", "***"]) + pick(upper + "_*", 5, 12), prose() + key()),
        lambda: ("_".join(rng.choice(DICTIONARY) for _ in range(rng.randint(2, 3))), prose() + key()),
        lambda: (rng.choice(DICTIONARY) + "-" + rng.choice(DICTIONARY), prose() + key()),

        lambda: (words(rng.randint(2, 4), rng.choice("-_/")) + rng.choice("-_/") + pick(digits, 1, 4), prose() + rng.choice(["", "see ", "https://example.com/"])),
        lambda: (str(uuid.UUID(int=rng.getrandbits(128))), prose() + rng.choice(["id: ", "uuid=", ""])),
        lambda: (pick(hexes, 40, 64), prose() + rng.choice(["commit ", "sha256:", "md5 ", "checksum: ", "digest="])),
        lambda: (f"20{pick(digits, 2, 2)}-{pick(digits, 2, 2)}-{pick(digits, 2, 2)}T{pick(digits, 2, 2)}", prose()),
        lambda: (pick(digits, 12, 20), prose() + rng.choice(["order ", "isbn ", "id=", ""])),
        lambda: (rng.choice(["your-api-key-", "example-token-", "dummy_password_", "xxxxxxxxxxxx", "changeme12345"]) + pick(digits, 1, 4), prose() + key()),
        lambda: (words(3, "") + pick(digits, 1, 2), prose()),
        lambda: ("".join(w.capitalize() for w in words(4, " ").split()), prose()),
        lambda: ("/".join(pick(letters, 2, 8) for _ in range(4)) + "/" + pick(digits, 1, 4), prose() + rng.choice(["", "src=", "/"])),
        lambda: (pick(letters, 2, 6) + "-" + pick(digits, 2, 4) + "-" + pick(letters, 3, 8), prose()),
    ]
    out = []
    for k in range(count):
        run, before = rng.choice(secret if k % 2 == 0 else other)()
        after = ('"' if before.endswith('"') else rng.choice([" ", "\n", ".", ", "])) + prose()[:15]
        out.append({"candidate": run, "before": before[-40:], "after": after[:20], "label": 1 - k % 2})
    return out


def grow_tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, tries: int) -> tuple | float:
    """(feature, threshold, below, above), or the share of label 1, by Gini gains over ``tries`` random features."""
    share = float(y.mean())
    if depth == 0 or len(y) < 8 or share in (0.0, 1.0):
        return share
    best = (1e-9, None, None)
    for f in rng.choice(x.shape[1], tries, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        n, left = at + 1.0, ones[at]
        right, rest = ones[-1] - left, len(y) - n
        gain = len(y) * share * (1 - share) - left * (1 - left / n) - right * (1 - right / rest)
        if len(at) and gain.max() > best[0]:
            k = int(gain.argmax())
            best = (float(gain[k]), int(f), float((v[at[k]] + v[at[k] + 1]) / 2))
    if best[1] is None:
        return share
    below = x[:, best[1]] < best[2]
    return best[1], best[2], grow_tree(x[below], y[below], rng, depth - 1, tries), grow_tree(x[~below], y[~below], rng, depth - 1, tries)


def forest_score(trees: list, names: list[str]) -> Column:
    """Mean of the trees as one expression."""

    def sql(node: tuple | float) -> str:
        if isinstance(node, float):
            return f"{node:.6f}D"
        f, threshold, below, above = node
        return f"if({names[f]} < {threshold!r}D, {sql(below)}, {sql(above)})"

    return F.expr(f"({' + '.join(sql(t) for t in trees)}) / {len(trees)}D")


def fit(spark: SparkSession, seed: int = 43) -> Column:
    """Trains the forest on the labelled findings and gives its score as a column over features()."""
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(labelled_findings())), "array<struct<candidate:string,before:string,after:string,label:int>>")))
    made = features()
    table = np.array([tuple(r) for r in rows.select(*(v.cast("double").alias(k) for k, v in made.items()), F.col("label").cast("double")).collect()])  # FINDINGS rows
    x, y = table[:, :-1], table[:, -1]
    rng = np.random.default_rng(seed)
    trees = []
    for _ in range(TREES):
        some = rng.integers(0, len(y), len(y))
        trees.append(grow_tree(x[some], y[some], rng, DEPTH, max(2, int(x.shape[1] ** 0.5) + 1)))
    return forest_score(trees, list(made))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, finding, candidate, before, after, score, secret) of every candidate."""
    score = fit(docs.sparkSession)
    found = candidates(docs)
    described = found.select("*", *(v.cast("double").alias(k) for k, v in features().items()))
    return described.select("doc_id", "finding", "candidate", "before", "after", score.alias("score")).withColumn("secret", F.col("score") >= SECRET)


def op7_secretscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents")).select("doc_id", "finding", "candidate", "score", "secret")
