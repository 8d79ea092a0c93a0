import json
import os
import time

import pytest

from inkspan.operators.search import search
from inkspan.streaming.pending import await_metadata, settled
from inkspan.streaming.segments import SegmentedIndex
from inkspan.streaming.vault import VaultWatcher
from inkspan.streaming.versions import Conflict

DDL = "stamp long, kind string, path string, old_path string, mtime long, title string, text string, tags array<string>"


def put(root, name, text, mtime=None):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    if mtime:
        os.utime(path, (mtime, mtime))


def kinds(watcher, version):
    return sorted((r.kind, r.path, r.old_path) for r in watcher.changes(version).collect())


def test_snapshots_become_changes(spark, tmp_path):
    vault = tmp_path / "vault"
    put(vault, "a.md", "alpha", 1000)
    put(vault, "sub/b.md", "beta", 1000)
    put(vault, "same1.md", "twin", 1000)
    put(vault, "same2.md", "twin", 1000)
    put(vault, "skip.txt", "no note", 1000)
    put(vault, "big.md", "x" * 500, 1000)
    watcher = VaultWatcher(spark, str(vault), f"file://{tmp_path}/state", max_bytes=100)
    assert kinds(watcher, watcher.poll()) == [("create", p, None) for p in ("a.md", "big.md", "same1.md", "same2.md", "sub/b.md")]
    assert {r.path: r.text for r in watcher.changes(0).collect()} == {"a.md": "alpha", "sub/b.md": "beta", "same1.md": "twin", "same2.md": "twin", "big.md": None}
    assert watcher.poll() is None
    put(vault, "a.md", "alpha 2", 2000)
    put(vault, "same1.md", "twin", 3000)  # touched, not changed
    (vault / "moved").mkdir()
    (vault / "sub/b.md").rename(vault / "moved/c.md")
    (vault / "same2.md").rename(vault / "moved/same3.md")
    put(vault, "moved/same4.md", "twin", 1000)  # two new files have these bytes: no rename
    assert kinds(watcher, watcher.poll()) == [("create", "moved/same3.md", None), ("create", "moved/same4.md", None), ("delete", "same2.md", None), ("modify", "a.md", None), ("rename", "moved/c.md", "sub/b.md")]
    first = sorted(map(tuple, watcher.changes(1).select("kind", "path", "text").collect()))
    again = VaultWatcher(spark, str(vault), f"file://{tmp_path}/state", max_bytes=100)
    assert sorted(map(tuple, again.changes(1).select("kind", "path", "text").collect())) == first and again.poll() is None


def test_a_file_that_changes_while_it_is_read_comes_again(spark, tmp_path):
    vault = tmp_path / "vault"
    put(vault, "a.md", "one", 1000)
    put(vault, "b.md", "steady", 1000)
    watcher = VaultWatcher(spark, str(vault), f"file://{tmp_path}/state")
    contents = watcher._contents

    def late(touched):
        rows = contents(touched).persist()
        rows.count()
        put(vault, "a.md", "other", 2000)
        return rows

    watcher._contents = late
    assert kinds(watcher, watcher.poll()) == [("create", "b.md", None)]
    watcher._contents = contents
    assert [(r.kind, r.text) for r in watcher.changes(watcher.poll()).collect()] == [("create", "other")]


def test_two_pollers_and_one_that_dies(spark, tmp_path):
    vault, state = tmp_path / "vault", f"file://{tmp_path}/state"
    put(vault, "a.md", "one", 1000)
    watcher, other = VaultWatcher(spark, str(vault), state), VaultWatcher(spark, str(vault), state)
    listing = watcher.listing
    watcher.listing = lambda: (other.poll() if other.version_free else None, listing())[1]
    other.version_free = True
    plain = other.listing
    other.listing = lambda: (setattr(other, "version_free", False), plain())[1]
    with pytest.raises(Conflict):
        watcher.poll()
    assert watcher.log.versions() == [0] and kinds(other, 0) == [("create", "a.md", None)]
    # dies between the commit and the publication
    put(vault, "a.md", "two two", 2000)
    dying = VaultWatcher(spark, str(vault), state)
    publish, calls = dying._publish, []
    dying._publish = lambda: calls.append(1) or (publish() if len(calls) == 1 else (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        dying.poll()
    last = VaultWatcher(spark, str(vault), state)
    assert last.poll() is None and kinds(last, 1) == [("modify", "a.md", None)]


def test_index_follows_a_burst(spark, tmp_path):
    """20 notes and 100 new ones; 50 edits and 25 deletes; 10 renames: 120, 95 and 95 notes."""
    vault = tmp_path / "vault"
    for k in range(20):
        put(vault, f"base/n{k}.md", f"base{k}", 1000)
    watcher = VaultWatcher(spark, str(vault), f"file://{tmp_path}/state")
    index = SegmentedIndex(spark, f"file://{tmp_path}/index", recheck=watcher.unchanged)

    def settle():
        watcher.poll()
        watcher.feed(index)
        return index.index().size().first()["n_notes"]

    paths = lambda query: {r.path for r in search(index.index(), query, 50).collect()}
    for k in range(100):
        put(vault, f"burst/note-{k}.md", f"# run {k}\ntoken{k} of the text {k}\n", 2000)
    assert settle() == 120
    for k in range(50):
        put(vault, f"burst/note-{k}.md", f"# run {k}\ntoken{k} of the text {k}\nadded edit{k}\n", 3000)
    for k in range(50, 75):
        (vault / f"burst/note-{k}.md").unlink()
    assert settle() == 95
    assert paths("edit10") == {"burst/note-10.md"} and paths("token60") == set() and paths("token99") == {"burst/note-99.md"}
    (vault / "renamed").mkdir()
    for k in range(10):
        (vault / f"burst/note-{k}.md").rename(vault / f"renamed/moved-{k}.md")
    assert settle() == 95
    assert paths("token0") == {"renamed/moved-0.md"} and watcher.feed(index) == 0
    assert kinds(watcher, watcher.log.latest()[0])[0] == ("rename", "renamed/moved-0.md", "burst/note-0.md")


def test_notes_wait_for_their_metadata(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    names = [c.split()[0] for c in DDL.split(", ")]

    def emit(name, *rows):
        (tmp_path / name).write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))
        (tmp_path / name).rename(feed / name)

    stream = await_metadata(spark.readStream.schema(DDL).json(str(feed)), passes=6, interval_ms=100)
    index = SegmentedIndex(spark, f"file://{tmp_path}/index")
    out = f"{tmp_path}/rows"

    def take(batch, number):
        batch.persist()
        batch.write.mode("append").parquet(out)
        if not batch.isEmpty():
            index.apply(settled(batch), number)
        batch.unpersist()

    emit("1.json", (1, "create", "ready.md", None, 1, "", "ready text", ["x"]), (2, "create", "late.md", None, 1, "", "late text", None), (3, "create", "never.md", None, 1, "", "never text", None), (4, "create", "gone.md", None, 1, "", "gone text", None), (5, "create", "old.md", None, 1, "", "moved text", ["y"]))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        def wait(test):
            until = time.time() + 120
            while not test():
                assert time.time() < until and query.exception() is None, query.exception()
                time.sleep(0.3)

        rows = lambda: spark.read.schema(DDL + ", passes int").parquet(out).collect() if os.path.isdir(out) else []
        wait(lambda: len(rows()) >= 5)
        emit("2.json", (6, "metadata", "late.md", None, None, None, None, ["z"]), (7, "delete", "gone.md", None, None, None, None, None), (8, "rename", "new.md", "old.md", 1, "", "moved text", ["y"]))
        wait(lambda: any(r.kind == "expired" for r in rows()) and any(r.path == "new.md" for r in rows()))
    finally:
        query.stop()
    found = rows()
    assert [(r.path, r.passes) for r in found if r.kind == "expired"] == [("never.md", 6)]
    late = [r for r in found if r.path == "late.md"]
    assert sorted(r.kind for r in late) == ["delete", "modify"] and next(r for r in late if r.kind == "modify").text == "late text"
    assert sorted(r.kind for r in found if r.path == "gone.md") == ["delete", "delete"]
    assert {r.path for r in index.index().chunks.select("path").collect()} == {"ready.md", "late.md", "new.md"}
