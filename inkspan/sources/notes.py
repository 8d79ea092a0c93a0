"""Where notes, truth and changes come from, and where results go."""

from __future__ import annotations

import json
import random
import urllib.parse
import urllib.request
from collections.abc import Callable
from datetime import date, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan import schema
from inkspan.functions.policy import MAX_BYTES
from inkspan.functions.text import safe_name  # noqa: F401  used for file names of fetched pages


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """All ``.md`` files below ``root`` (path, modificationTime, length, content); what is not selected is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)


def relative_path(root: str) -> Column:
    """The path of a file below ``root``."""
    base = root.rstrip("/").removeprefix("file://") + "/"
    return F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + "".join(f"\\{c}" if not c.isalnum() and c not in "/_" else c for c in base), "")


def title_of(path: str | Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")


def read_markdown(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Notes (path, title, text, tags, size, mtime) of all ``.md`` files below ``root``; larger files are not opened (the size is pushed to the scan)."""
    files = markdown_files(spark, root).where(F.col("length") <= max_bytes)
    return files.select(relative_path(root).alias("path"), title_of("path").alias("title"), F.decode("content", "UTF-8").alias("text"), F.array().cast("array<string>").alias("tags"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))


def count_oversized(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> int:
    """Files that read_markdown leaves out; metadata only."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    return files.where(F.col("length") > max_bytes).select("length").count()


def document_notes(documents: DataFrame) -> DataFrame:
    """The table ``documents`` as notes."""
    return documents.select(F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("path"), F.col("source").alias("title"), "text")


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries, relevance) of a ground-truth JSON file."""
    truth = spark.read.schema(schema.GROUND_TRUTH).json(path, multiLine=True)
    return truth.select(F.inline("queries")), truth.select(F.inline("relevance"))


def write_truth(queries: DataFrame, relevance: DataFrame, path: str, **header: Any) -> None:
    """A truth file from bounded query sets."""
    rows = {**header, "queries": [r.asDict() for r in queries.collect()], "relevance": [r.asDict() for r in relevance.collect()]}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def write_corpus(notes: DataFrame, path: str) -> None:
    """Notes as Parquet; a corpus of millions of files is no use to a cluster."""
    notes.write.mode("overwrite").parquet(path)


#: Subjects of the made-up corpus, of a town library with a garden: a name, a fact and a question in other words.
_SUBJECTS = [
    ("温室の水やり", "温室の水やりは朝七時と夕方五時の二回", "ガラスの部屋の草花はいつ潤す"),
    ("貸出冊数", "貸出冊数は一人十二冊、絵本は別に六冊", "一度に何さつ持ち帰れる"),
    ("蜂箱の点検", "蜂箱の点検は晴れた水曜だけ行う", "虫の巣を開けて見る条件"),
    ("点字図書", "点字図書は二階の東棚に並ぶ", "指で読む本の場所"),
    ("読み聞かせ会", "読み聞かせ会は第一土曜の十時から", "子どもに物語を語る集まりの時刻"),
    ("堆肥づくり", "堆肥づくりは落ち葉と米ぬかを三対一で混ぜる", "土の肥やしの割合"),
    ("返却ポスト", "返却ポストは閉館の間だけ開く", "夜に借りたものを戻すには"),
    ("自習席", "自習席は一回三時間、延長は一度まで", "机を使える長さ"),
    ("古地図", "古地図は白い手袋で開き、写しを渡す", "昔の町の図面を見る作法"),
    ("種の交換棚", "種の交換棚は一袋入れて一袋取る", "まくものを分け合う約束"),
    ("映写室", "映写室は二十四席で飲み物は持ち込めない", "フィルムを映す部屋の広さ"),
    ("移動図書車", "移動図書車は隔週で北の集落を回る", "本を積んで走る乗り物の行き先"),
    ("雨水タンク", "雨水タンクは四百リットル、冬は空にする", "空から落ちた水をためる器の大きさ"),
    ("製本教室", "製本教室は糸と針と和紙を使う", "綴じ方を習うときの道具"),
    ("バラの剪定", "バラの剪定は二月の終わりに済ませる", "とげのある花を切る季節"),
    ("郷土新聞", "郷土新聞は明治三十年から揃う", "地元の記事はどこまで遡れる"),
    ("利用カード", "利用カードは五年で書き換える", "会員のしるしの寿命"),
    ("音訳奉仕", "音訳奉仕は十回の講習を終えた人が担う", "声に吹き込む手伝いの資格"),
    ("池の金魚", "池の金魚は水温が十度を切ると餌を止める", "赤い魚に食べさせない時期"),
    ("寄贈本", "寄贈本は刊行から八年以内のものを受ける", "読み終えたものをもらってくれる条件"),
    ("展示ケース", "展示ケースの湿度は五十五に保つ", "飾り棚の中の空気"),
    ("芝生ひろば", "芝生ひろばは花見の週だけ夜も開く", "緑の上に座れる遅い時間"),
    ("朗読劇", "朗読劇の稽古は木曜の閉館後", "台本を声に出す練習の日"),
    ("除籍市", "除籍市は秋分の日に中庭で開く", "棚から外した品を譲る催し"),
]
#: Kinds of notes that concern no subject, and how many sentences they have.
_FILLERS = {"天気帳": 2, "鳥の観察": 4, "来館者の声": 3, "買いもの控え": 6, "長い聞き書き": 60}
_PHRASES = ["風が南に変わった", "つぐみが三羽来た", "椅子のねじを締めた", "廊下の灯りが一つ切れた", "糊を二瓶買った", "祖母の代の話を聞いた", "橋のたもとで休んだ", "霜柱を踏んで歩いた"]


def make_corpus(spark: SparkSession, notes: int = 400, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, queries, relevance) of a made-up corpus, a function of ``seed``.

    Each subject has a note that states its fact (grade 2), one that mentions it (grade 1) and two queries; every fourth
    of the other notes names a subject without a word of its fact, the others concern none.
    """
    rng = random.Random(seed)
    rows, queries, relevance = [], [], []

    def day() -> str:
        return (date(2021, 4, 1) + timedelta(days=rng.randrange(1500))).isoformat()

    for k, (name, fact, question) in enumerate(_SUBJECTS):
        stated, mentioned = f"手引き/{name}.md", f"会合/{day()}-{k}.md"
        rows.append((stated, name, f"# {name}\n\n{fact}。{day()}に改めた。\n"))
        rows.append((mentioned, "会合", f"# 会合の控え\n\n{name}のことが話に出たが、決めずに終えた。\n"))
        for kind, text in (("literal", f"{name}の決まり"), ("synonym", question)):
            queries.append((f"q{k}:{kind}", kind, text))
            relevance += [(f"q{k}:{kind}", stated, 2), (f"q{k}:{kind}", mentioned, 1)]
    for k in range(notes - len(rows)):
        if k % 4 == 3:
            rows.append((f"余談/{k}.md", "余談", f"{rng.choice(_SUBJECTS)[0]}の帰りに{rng.choice(_PHRASES)}。{day()}\n"))
            continue
        kind = rng.choice(list(_FILLERS))
        rows.append((f"{kind}/{k}.md", kind, "".join(f"{day()} {rng.choice(_PHRASES)}。\n" for _ in range(_FILLERS[kind]))))
    return (
        spark.createDataFrame([(*r, []) for r in rows], schema.NOTE).select("path", "title", "text", "tags"),
        spark.createDataFrame(queries, schema.QUERY),
        spark.createDataFrame(relevance, schema.RELEVANCE),
    )


def fetch_pages(api: str, page_ids: list[int], get: Callable[[str], Any] | None = None, batch: int = 20, attempts: int = 6, sleep: Callable[[float], None] | None = None) -> list[dict]:
    """Introductions of encyclopedia pages by id, in batches, with linear back-off; what was fetched is kept when a batch fails for good."""
    import time

    def load(url: str) -> Any:
        with urllib.request.urlopen(url, timeout=30) as got:
            return json.load(got)

    get, sleep, out = get or load, sleep or time.sleep, {}
    for at in range(0, len(page_ids), batch):
        ids = "|".join(map(str, page_ids[at : at + batch]))
        url = api + "?" + urllib.parse.urlencode({"action": "query", "format": "json", "prop": "extracts|revisions", "rvprop": "ids", "exintro": 1, "explaintext": 1, "exlimit": "max", "pageids": ids, "maxlag": 5})
        for attempt in range(attempts):
            try:
                answer = get(url)
                if "error" in answer:
                    raise OSError(str(answer["error"]))
                break
            except OSError:
                if attempt + 1 == attempts:
                    return list(out.values())
                sleep(attempt + 1)
        for page in answer.get("query", {}).get("pages", {}).values():
            if page.get("extract"):
                out.setdefault(page["pageid"], {"pageid": page["pageid"], "revid": (page.get("revisions") or [{}])[0].get("revid"), "title": page["title"], "text": page["extract"]})
    return list(out.values())
