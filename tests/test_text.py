import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from inkspan.functions import policy, settings
from inkspan.functions import text as tx

GOLDEN = [
    ("ＢＭ２５ 管理 再ランキング", ["bm25", "管理", "w:管理", "c:管", "c:理", "再ラ", "ラン", "ンキ", "キン", "ング", "w:ランキング", "c:再"]),
    ("Foo_bar １２３ a-b 日 あ カ ｶﾀｶﾅ", ["foo_bar", "123", "a", "b", "日", "c:日", "あ", "カ", "カタ", "タカ", "カナ", "w:カタカナ"]),
    ("𠮷野家 😀 ABC", ["𠮷野", "野家", "w:𠮷野家", "c:𠮷", "c:野", "c:家", "abc"]),
    ("! 😀", []),
    ("", []),
    ("デプロイ", ["デプ", "プロ", "ロイ", "w:デプロイ"]),
    ("カ", ["カ"]),
    ("有給休暇", ["有給", "給休", "休暇", "w:有給休暇", "c:有", "c:給", "c:休", "c:暇"]),
    ("café Привет", ["caf"]),
]


def test_token_goldens(spark):
    rows = spark.createDataFrame([(t,) for t, _ in GOLDEN], "text string")
    got = {r.text: r.tokens for r in rows.withColumn("tokens", tx.tokens(tx.fold(F.col("text")))).collect()}
    assert got == dict(GOLDEN)


def test_token_variants_and_weights(spark):
    rows = spark.createDataFrame([("デプロイ",)], "text string")
    made = rows.select(*(t(tx.fold(F.col("text"))).alias(n) for n, t in tx.TOKENIZERS.items())).first()
    assert made["bigram"] == ["デプ", "プロ", "ロイ"] and made["katakana3"][-1] == "K:デプロイ"
    weights = spark.createDataFrame([("w:x",), ("c:x",), ("x",)], "t string").select(tx.token_weight(F.col("t"))).collect()
    assert [r[0] for r in weights] == [1.2, 0.5, 1.0]


def test_few_texts_go_to_python(spark):
    """F15, F16, F17, F21: texts of full-width forms, Han, Hiragana or Katakana all went there to be normalized."""
    rng = random.Random(5)
    kinds = ["ＢＭ２５！～ａ", "管理再一龿", "あぁゖん", "ァヺラー", "ab é", "が", "゙", "ﾗｯ", "①", "ﬁ", "e\u0301"]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 9))) for _ in range(2000)] + kinds
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = tx.narrowed(F.col("text"))
    got = rows.select("text", tx.fold(F.col("text")).alias("folded"), tx.is_stable(plain).alias("stable"), plain.alias("plain")).collect()
    assert all(r.folded == unicodedata.normalize("NFKC", r.text).lower() for r in got)
    assert all(r.plain == unicodedata.normalize("NFKC", r.text) for r in got if r.stable)
    assert [r.stable for r in got[-len(kinds) :]] == [True] * 6 + [False] * 5


def test_hashes_and_ids(spark):
    def plain(text):
        h = 0x811C9DC5
        raw = text.encode("utf-16-le")
        for k in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[k : k + 2], "little")) * 0x01000193) & 0xFFFFFFFF
        return f"{h:08x}"

    texts = ["", "a", "日本語", "😀x", "a" * 1300]
    assert tx.fnv_hashes(texts) == [plain(t) for t in texts]
    row = spark.createDataFrame([('p"/x.md', 3, 0, "é")], "path string, line int, ordinal int, text string")
    got = row.select(tx.chunk_id("path", "line", "ordinal", tx.content_hash("text"))).first()[0]
    assert json.loads(got) == ['p"/x.md', 3, 0, plain("é")] and ", " not in got


def test_small_functions(spark):
    row = spark.createDataFrame([("a/b:c#[d]", "。".join(["x" * 20, "short", "y" * 30])), ], "name string, text string")
    out = row.select(tx.safe_name(F.col("name")), tx.pick_sentence(F.col("text"), F.lit("zzz"), F.lit(3)), tx.pick_sentence(F.lit("no"), F.lit("z"), F.lit(1)), tx.cost_text(F.lit(None).cast("double"), F.lit(1000), 0.04), tx.cost_text(F.lit(None).cast("double"), F.lit(None).cast("int"), 0.04)).first()
    assert tuple(out) == ("a_b_c__d_", "y" * 30, None, "$0.000040", "unknown")


EXCLUDED = ["Private/a.md", "private", "Archive/old/a.md", "Settings/a.md", ".vault/a.md", "a/.cache/n.md", "a\\.cache\\n.md", "./Private//a.md", "x/../Private/a.md", "../a.md"]
KEPT = ["Privateish/a.md", "Archive/older/a.md", "Settings2/a.md", "x/Private/a.md", "public/a.md", ".hidden.md"]


def test_exclusion(spark):
    rows = spark.createDataFrame([(p,) for p in EXCLUDED + KEPT], "path string")
    none = policy.texts([])
    verdict = policy.is_excluded(F.col("path"), none, policy.texts(["Private", "Archive/old/"]), none, F.lit("Settings"))
    got = {r.path: r.v for r in rows.select("path", verdict.alias("v")).collect()}
    assert got == {**dict.fromkeys(EXCLUDED, True), **dict.fromkeys(KEPT, False)}


@pytest.mark.parametrize(("folders", "config", "expected"), [([""], "", False), (["/"], "", True), ([], ".", True)])
def test_exclusion_of_everything(spark, folders, config, expected):
    none = policy.texts([])
    got = spark.range(1).select(policy.is_excluded(F.lit("any.md"), none, policy.texts(folders), none, F.lit(config))).first()[0]
    assert got is expected


def test_tags_and_admission(spark):
    none = policy.texts([])
    rows = spark.createDataFrame([("#Private", True), ("private/child", True), ("privateish", False), ("x/private", False)], "tag string, expected boolean")
    got = rows.select(policy.is_excluded(F.lit("a.md"), F.array("tag"), none, policy.texts(["#private", ""]), F.lit("")).alias("v"), "expected").collect()
    assert all(r.v == r.expected for r in got)
    files = spark.createDataFrame([("a.md", 10, []), ("a.txt", 10, []), ("b.md", 2_000_000, []), ("c.md", 10, None)], "path string, size long, tags array<string>")
    ok = files.where(policy.allowed(F.col("path"), F.col("size"), F.col("tags"), none, none, F.lit(""))).collect()
    assert [r.path for r in ok] == ["a.md"]


def test_settings(tmp_path):
    bad = {"folders": "x", "tags": ["a", 1], "enabled": "true", "target": ["x"], "secret_ids": {"pinned": "Bad Name"}, "cache_ttl_minutes": 99, "other": 1}
    got = settings.load_settings(bad)
    assert got == settings.Settings(secret_ids=dict.fromkeys(settings.TARGETS, ""))
    assert settings.as_ttl(True) == 30 and settings.as_ttl(0) == 0 and settings.as_ttl(1.5) == 30
    assert settings.parse_folders("a\n\n b ") == ("a", "b") and settings.parse_folders("../x") is None and settings.parse_folders("C:") is None
    store = settings.SettingsStore(str(tmp_path / "s.json"))
    assert store.load() == settings.Settings()
    store.save(settings.Settings(folders=("x",), enabled=True))
    assert store.load().folders == ("x",) and store.load().enabled
    held = settings.Credentials(lambda name: {"k": "stored"}.get(name) or 1 / 0)
    chosen = settings.Settings(secret_ids={"pinned": "k", "hosted": "missing"})
    assert held.resolve("pinned", chosen) == "stored" and held.resolve("hosted", chosen) == ""
    held.set_for_session("hosted", "mine")
    assert held.resolve("hosted", chosen) == "mine"
