"""Index, search, read, maintain, export and import over a store; sources; streaming."""

import os
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from lodeseek import store
from lodeseek.cli import main
from lodeseek.engine import Engine
from lodeseek.operators import changes, evaluation, indexing, maintenance, search
from lodeseek.sources import archive, config, filters, git, git_tree
from lodeseek.sources.scan import scan
from lodeseek.store import TABLES, Store
from lodeseek.streaming import ingest

FILES = [("a.txt", "alpha beta gamma"), ("b.md", "# One\nalpha\n# Two\ndelta beta alpha"), ("c.java", "package p;\nclass C {\n  void m() { }\n}\n")]


def frame(spark, files):
    return spark.createDataFrame(files, "path string, content string")


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), {"summarization": {"enabled": True}})
    e.index_documents("docs", frame(spark, FILES), as_of="2024-01-01 00:00:00")
    return e


def state(engine):
    """What a store holds, without times."""
    out = {}
    for name, df in engine.store.tables().items():
        keep = [c for c in df.columns if not c.endswith("_at")]
        out[name] = sorted(map(str, (r.asDict() for r in df.select(*keep).collect())))
    return out


def test_index_and_status(engine):
    s = engine.status()
    assert (s["sources"], s["views"], s["files"], s["chunks"], s["embedded"]) == (1, 1, 3, 5, 5)


def test_incremental_is_full(spark, tmp_path, engine):
    new = [("a.txt", "alpha beta gamma"), ("b.md", "# One\nchanged"), ("d.txt", "fresh text")]
    counts = engine.index_documents("docs", frame(spark, new))
    assert (counts["new"], counts["deleted"], counts["unchanged"]) == (2, 1, 1)
    other = Engine(spark, str(tmp_path / "other"), {"summarization": {"enabled": True}})
    other.index_documents("docs", frame(spark, new))
    engine.gc(0, "2100-01-01 00:00:00")
    assert state(engine) == state(other)


def test_search(engine):
    rows = engine.search("alpha", 3).orderBy("place").collect()
    assert rows and rows[0].source_name == "docs" and rows[0].scores.rerank == 1.0
    assert {r.path for r in engine.search("alpha beta", path_prefix="b").collect()} == {"b.md"}
    assert engine.search("alpha", source_type="code").collect()[0].path == "c.java"
    for bad in (dict(top_k=0), dict(source_id="x", source_name="y"), dict(source_name="nope")):
        with pytest.raises(ValueError):
            engine.search("alpha", **bad)
    assert engine.search("alpha", branch="nope").count() == 0


def test_read(engine):
    assert engine.read_source(path="a.txt")["content"] == "alpha beta gamma"
    assert engine.read_source(path="b.md", header_path="# Two")["content"] == "# Two\ndelta beta alpha"
    got = engine.read_source(path="b.md", start_line=2, context=1)
    assert (got["start_line"], got["end_line"], got["content"]) == (1, 3, "# One\nalpha\n# Two")
    chunk = engine.store.table("chunks").where("path = 'c.java' and metadata like '%METHOD%'").first()
    assert engine.read_source(chunk_id=chunk.id)["content"].strip() == "void m() { }"
    assert engine.read_source(path="a.txt", branch="nope")["warning"] and engine.read_source(path="zzz") is None


def test_summaries_and_three_way(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), {"summarization": {"enabled": True}, "search": {"useSummaryVector": True, "bm25Weight": 0.3, "vectorWeight": 0.5, "summaryVectorWeight": 0.2}})
    e.index_documents("docs", frame(spark, [("a.txt", "alpha " * 60), ("b.txt", "short")]))
    assert e.summarize(dry_run=True)["expected"] == 1
    assert e.summarize() == {"summarized": 1, "skipped": 1} and e.summarize() == {}
    row = {r.summary[:8]: r.summary_embedding for r in e.store.table("chunk_contents").collect()}
    assert row["[skipped"] is None and len(row["Mock sum"]) == 64
    assert e.search("alpha").first().scores.summary is not None
    with pytest.raises(RuntimeError):
        Engine(spark, str(tmp_path / "off")).summarize()


def test_repair_and_re_embed(spark, engine):
    t = engine.store.tables()
    engine.store.commit({"chunks": t["chunks"].where("path <> 'b.md'"), "chunk_contents": t["chunk_contents"].withColumn("embedding", F.when(F.col("content").contains("gamma"), None).otherwise(F.col("embedding")))})
    assert engine.repair() == 1 and engine.repair() == 0 and engine.re_embed() == 1 and engine.re_embed() == 0
    assert engine.status()["chunks"] == 5 and engine.re_embed(force=True) == 5


def test_failing_embedder_defers(spark):
    calls = []

    def flaky(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[1.0, 0.0]] * len(texts)

    df = spark.createDataFrame([("x",), ("bad",), ("y",)], "t string").coalesce(1)
    got = {r.t: r.e for r in indexing.BatchEmbedder(flaky, 2, batch=1).embed(df, "t", "e").collect()}
    assert got == {"x": [1.0, 0.0], "bad": None, "y": [1.0, 0.0]} and not calls


def test_embedding_batches_in_flight(spark, tmp_path):
    log = str(tmp_path / "log")

    def slow(texts):
        start = time.monotonic()
        time.sleep(0.2)
        with open(log, "a") as f:
            f.write(f"{start} {time.monotonic()}\n")
        if "7" in texts:
            raise RuntimeError("no")
        return [[float(t)] for t in texts]

    df = spark.createDataFrame([(str(i),) for i in range(24)], "t string").coalesce(1)
    for at_once in (1, 3):
        got = {r.t: r.e for r in indexing.BatchEmbedder(slow, 1, batch=2, at_once=at_once).embed(df, "t", "e").collect()}
        assert got == {str(i): None if i in (6, 7) else [float(i)] for i in range(24)}  # the failed batch alone, in order
        spans = [tuple(map(float, line.split())) for line in open(log)]
        assert len(spans) == 13 and max(sum(a <= s < b for a, b in spans) for s, _ in spans) == at_once
        took = max(b for _, b in spans) - min(a for a, _ in spans)
        assert took >= 2.6 if at_once == 1 else took < 1.6
        os.remove(log)


def test_remove_and_gc(engine):
    assert engine.remove("docs") and not engine.remove("docs")
    s = engine.status()
    assert (s["sources"], s["views"], s["files"], s["chunks"], s["contents"]) == (0, 0, 0, 0, 5)
    assert engine.gc(60, "2024-01-01 00:30:00") == {"chunk_contents": 0, "file_blobs": 0}
    assert engine.gc(60, "2024-01-02 00:00:00") == {"chunk_contents": 5, "file_blobs": 3}


@pytest.mark.parametrize("name", ["folder", "x.tar", "x.tar.gz"])
def test_export_import(spark, tmp_path, engine, name):
    target = str(tmp_path / name)
    m = engine.export(target, sql=True)
    assert m["version"] == 2 and m["sources"][0]["chunkCount"] == 5 and archive.listed(target) == ["docs"]
    other = Engine(spark, str(tmp_path / "other"))
    assert other.import_(target, remap=("docs", "/nowhere"))[0] == ["docs"]
    assert {k: v for k, v in state(other).items() if k != "sources"} == {k: v for k, v in state(engine).items() if k != "sources"}
    assert other.import_(target) == ([], ["docs"], []) and other.import_(target, on_conflict="force")[0] == ["docs"]
    assert other.status()["chunks"] == 5
    with pytest.raises(ValueError):
        other.import_(target, on_conflict="fail")


def test_manifest_versions():
    for bad in ({"version": 1}, {"version": 2, "schemaVersion": 9}, {"version": 2, "schemaVersion": 1, "sources": [{}]}):
        with pytest.raises(ValueError):
            archive.checked(bad)


def test_store_swaps_at_once(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    row = spark.createDataFrame([("h", "c", 1, None)], TABLES["file_blobs"])
    s.commit({"file_blobs": row})
    before = s.table("file_blobs")
    s.commit({"file_blobs": before.unionByName(row.withColumn("content_hash", F.lit("i")))})
    assert before.count() == 1 and s.table("file_blobs").count() == 2 and s.vacuum() == 1


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_incremental_commit_writes_what_changed(spark, tmp_path):
    """A file of 400 changed: one commit, hardly any bytes, deletions applied, and the same after compacting."""
    import random

    rng = random.Random(1)
    files = [(f"d/{i}.txt", " ".join(f"w{rng.randrange(5000)}" for _ in range(300))) for i in range(400)]
    e = Engine(spark, f"file://{tmp_path}/store")
    e.index_documents("docs", frame(spark, files))
    before, (n, _) = {t: size_of(tmp_path / "store" / t) for t in ("file_blobs", "chunk_contents", "postings", "chunks")}, e.store.current()
    counts = e.index_documents("docs", frame(spark, [(p, t + " zebra") if p == "d/7.txt" else (p, t) for p, t in files if p != "d/9.txt"]))
    assert (counts["new"], counts["deleted"], counts["unchanged"]) == (1, 1, 398) and e.store.current()[0] == n + 1
    for t in ("file_blobs", "chunk_contents"):
        assert size_of(tmp_path / "store" / t) - before[t] < 0.05 * before[t]
    assert size_of(tmp_path / "store" / "chunks") - before["chunks"] < 0.3 * before["chunks"]  # ids and headers
    assert [r.path for r in e.search("zebra", 50).where("scores.text is not null").collect()] == ["d/7.txt"] and e.status()["files"] == 399
    held = state(e)
    for t in ("chunks", "indexed_files", "postings"):
        e.store.compact(t)
    assert state(e) == held and e.store.vacuum() > 0 and state(e) == held and e.store.vacuum() == 0


def test_second_writer_fails(spark, engine):
    one, two = engine.store.change(), engine.store.change()
    row = spark.createDataFrame([("h", "c", 1, None)], TABLES["file_blobs"])
    one.add("file_blobs", row), two.add("file_blobs", row)
    one.commit()
    with pytest.raises(RuntimeError, match="another writer"):
        two.commit()
    assert engine.store.table("file_blobs").where("content_hash = 'h'").count() == 1


def test_deletions_hold_for_earlier_parts_only(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    row = lambda *hashes: spark.createDataFrame([(h, "c", 1, None) for h in hashes], TABLES["file_blobs"])
    for h in range(store.MOST_DELETIONS + 3):  # beyond so many, the parts become one
        c = s.change()
        c.remove("file_blobs", row("a").select("content_hash"))
        c.add("file_blobs", row("a", f"b{h}"))
        c.commit()
    got = sorted(r.content_hash for r in s.table("file_blobs").collect())
    assert got == sorted(["a", *(f"b{h}" for h in range(store.MOST_DELETIONS + 3))]) and sum("gone" in e for e in s.current()[1]["file_blobs"]) < store.MOST_DELETIONS


def test_store_of_schema_1_is_migrated(spark, tmp_path, engine):
    import json

    old, tables = tmp_path / "old", {}
    for name, df in engine.store.tables().items():
        tables[name] = "v1"
        df.write.parquet(str(old / name / "v1"))
    (old / "current.json").write_text(json.dumps({"schema": 1, "tables": tables}))
    e = Engine(spark, str(old))
    assert state(e) == state(engine) and not (old / "current.json").exists()
    assert [r.path for r in e.search("gamma").where("scores.text is not null").collect()] == ["a.txt"] and e.store.table("postings").count() == engine.store.table("postings").count()
    with pytest.raises(RuntimeError):
        (tmp_path / "new").mkdir(), (tmp_path / "new" / "current.json").write_text('{"schema": 9, "tables": {}}'), Engine(spark, str(tmp_path / "new")).status()


def test_search_by_postings_and_lists(spark, tmp_path):
    """Postings give what scanning the texts gives; the approximate index finds the nearest, later contents included."""
    import random

    rng = random.Random(4)
    files = [(f"{i}.txt", " ".join(rng.choice(["alpha", "beta", "gamma", "delta", f"w{i}"]) for _ in range(40))) for i in range(120)]
    e = Engine(spark, str(tmp_path / "s"), {"search": {"approximate": True}})
    e.index_documents("docs", frame(spark, files))
    t, posts, views = e.store.tables(), e.store.table("postings"), e.scope()
    for q in ("alpha", "alpha beta", "Beta, delta gamma", "w7", "nowhere", "..."):
        hashes = search.scope_hashes(t["chunks"], views)
        want = search.text_search(t["chunk_contents"].join(hashes, "content_hash", "left_semi"), q, 20).collect()
        assert sorted(search.postings_search(posts, hashes, q, 20).collect()) == sorted(want), q
    made = e.build_vector_index(8)
    assert made["recall"] >= 0.9 and 1 <= made["probes"] <= 8
    e.index_documents("more", frame(spark, [("late.txt", "omega words")]))
    contents = e.store.table("chunk_contents")
    assert e.store.table("vectors").count() == contents.count()
    late = contents.where("content like 'omega%'").select("content_hash", "embedding").first()
    assert e._near(contents, list(late.embedding), 1).collect() == [(late.content_hash, 1.0)]
    assert [r.path for r in e.search("omega", 50).where("scores.text is not null").collect()] == ["late.txt"]


def test_coded_vectors_follow_the_store(spark, tmp_path):
    """After any change of vectors the index holds the store's; vectors of another length end it; removed contents leave it."""
    files = [(f"{i}.txt", f"text {i} of many") for i in range(60)]
    e = Engine(spark, str(tmp_path / "s"), {"search": {"approximate": True}})
    e.index_documents("docs", frame(spark, files))
    e.build_vector_index(4)
    held = lambda t: {r.content_hash: list(r.embedding) for r in e.store.table(t).select("content_hash", "embedding").collect()}
    assert held("vectors") == held("chunk_contents")

    class Shifted(indexing.HashEmbedder):
        def embed(self, rows, text_col, out):
            return super().embed(rows.withColumn("_t", F.concat(F.lit("other "), text_col)), "_t", out).drop("_t")

    before = held("vectors")
    e.embedder = Shifted(64)
    e.re_embed(force=True)
    after = held("vectors")
    assert after == held("chunk_contents") and len(after) == 60 and not any(after[h] == v for h, v in before.items())
    e.index_documents("docs", frame(spark, files[:40] + [("new.txt", "another text")]))
    e.gc(0, as_of="2100-01-01 00:00:00")
    assert held("vectors") == held("chunk_contents") and len(held("vectors")) == 41
    found = e._near(e.store.table("chunk_contents"), e.embedder.query("x"), 5).collect()
    assert 0 < len(found) <= 5 and {r.id for r in found} <= set(held("chunk_contents"))
    e.store.compact("chunk_contents")
    assert held("vectors") == held("chunk_contents")
    e.embedder = indexing.HashEmbedder(16)
    e.re_embed(force=True)
    assert e.store.model() is None and e.store.table("vectors").count() == 0 and e.search("another", 5).count() == 5


def test_parts_grow_slowly(spark, tmp_path, monkeypatch):
    """Forty small commits with deletions: few parts, few rows written again, the same rows."""
    monkeypatch.setattr(store, "FAN", 3)
    monkeypatch.setattr(store, "LOWEST", 4)
    s, want, most = Store(spark, str(tmp_path)), {}, 0
    add = store.Change.add
    monkeypatch.setattr(store.Change, "add", lambda self, name, df: (lambda out: (counted.append(out.count()), out)[1])(add(self, name, df)))
    counted = []
    for k in range(40):
        c = s.change()
        rows = [(f"h{3 * k + i}", f"v{k}", 1, None) for i in range(3)]
        if k % 5 == 4:  # rows of earlier commits come again
            rows[0] = (f"h{k}", f"again {k}", 1, None)
            c.remove("file_blobs", spark.createDataFrame([(r[0],) for r in rows], "content_hash string"))
        c.add("file_blobs", spark.createDataFrame(rows, TABLES["file_blobs"]))
        c.commit()
        want |= {r[0]: r[1] for r in rows}
        most = max(most, len(s.current()[1]["file_blobs"]))
    assert {r.content_hash: r.content for r in s.table("file_blobs").collect()} == want and s.table("file_blobs").count() == len(want)
    assert most <= 3 * 5 + 8 and sum(counted) <= 120 * 7
    held = s.table("file_blobs").count()
    assert s.vacuum() > 0 and s.table("file_blobs").count() == held


def test_full_tiers():
    part = lambda n: {"rows": "x", "n": n}
    low, mid, high = 1, store.LOWEST * store.FAN, store.LOWEST * store.FAN**3
    full = store.Store._full_tier
    assert full([part(low)] * (store.FAN - 1)) is None and full([part(high)] + [part(low)] * store.FAN) == 1
    assert full([part(high), part(mid)] + [part(low)] * (store.FAN - 1)) is None and full([part(mid)] * store.FAN) == 0
    assert full([part(high), *[part(mid)] * (store.FAN - 1), part(low), part(mid)]) == 1
    assert full([part(high), {"gone": "y", "by": ["k"]}, *[part(low)] * store.FAN]) == 2 and full([]) is None


def scanned(df):
    """Rows that the scans of files give, by the plan's own counts."""
    df.collect()
    n, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if "FileSourceScan" in p.getClass().getSimpleName():
            n += p.metrics().apply("numOutputRows").value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
        for name in ("AdaptiveSparkPlanExec", "QueryStageExec"):
            if name in p.getClass().getSimpleName():
                todo.append(p.executedPlan() if name.startswith("Adaptive") else p.plan())
    return n


def test_sorted_parts_leave_out_what_isnt_asked(spark, tmp_path, monkeypatch):
    """A term and a path prefix of a view read a small share of the rows, as row groups are left out by their statistics."""
    monkeypatch.setattr(store, "GROUP_BYTES", 16 << 10)
    e = Engine(spark, str(tmp_path / "s"))
    e.index_documents("docs", frame(spark, [(f"d{i % 50}/{i}.txt", " ".join(f"w{(i * 37 + k) % 4000}" for k in range(60))) for i in range(3000)]))
    posts = e.store.table("postings")
    assert scanned(posts.where("term = 'w777'")) <= posts.count() / 4
    chunks = e.store.table("chunks")
    assert scanned(e.scope(path_prefix="d7/").of(chunks).select("path")) <= chunks.count() / 2


# --- sources ---


def sh(folder, *args):
    subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", *args], cwd=folder, check=True, capture_output=True)


def put(folder, files):
    for p, t in files.items():
        full = os.path.join(folder, p)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(t)


def test_scan(spark, tmp_path):
    base = str(tmp_path / "a b")
    put(base, {"x.txt": "1", "sub/y.md": "2", ".hidden/z.txt": "3", "node_modules/m.js": "4", "p.png": "5", "big.txt": "x" * (1 << 20) + "y", "skip/q.txt": "6", "keep.log": "7", "other.log": "8", ".gitignore": "*.log\n!keep.log\nskip/\n"})
    files, excluded = scan(spark, base)
    assert {(r.path, r.content) for r in files.collect()} == {("x.txt", "1"), ("sub/y.md", "2"), ("keep.log", "7")}
    assert {"p.png", "big.txt", "skip/q.txt", "other.log"} <= {r.path for r in excluded.collect()}
    assert {r.path for r in scan(spark, base, ["**/*.md"])[0].collect()} == {"sub/y.md"}
    assert {r.path for r in scan(spark, base, exclude=["sub"])[0].collect()} == {"x.txt", "keep.log"}


@pytest.mark.parametrize("line,path,hit", [("*.log", "a/b.log", True), ("/a", "b/a", False), ("/a", "a/x", True), ("a/", "a", False), ("a/", "a/x", True), ("**/x", "x", True), ("d/**", "d/e/f", True), ("?.c", "ab.c", False), ("[ab].c", "b.c", True), ("# c", "# c", False)])
def test_rules(spark, line, path, hit):
    r = filters.Rules.compiled([line])
    assert r.ignores(path) == hit
    assert spark.range(1).select(r.kept(F.lit(path))).first()[0] == (not hit)


def test_git_index(spark, tmp_path):
    repo = str(tmp_path / "repo")
    os.makedirs(repo)
    sh(repo, "init", "-q", "-b", "main")
    put(repo, {"a.txt": "alpha", "b.txt": "beta"})
    sh(repo, "add", "."), sh(repo, "commit", "-qm", "1")
    e = Engine(spark, str(tmp_path / "store"))
    assert e.index_path(repo)["new"] == 2 and e.index_path(repo)["strategy"] == "skip"
    put(repo, {"b.txt": "changed", "c.txt": "new"})
    sh(repo, "add", "."), sh(repo, "commit", "-qm", "2")
    got = e.index_path(repo)
    assert got["strategy"] == "diff" and got["new"] == 2 and got["unchanged"] == 0
    put(repo, {"d.txt": "untracked"})
    assert e.index_path(repo)["new"] == 1
    os.remove(os.path.join(repo, "d.txt"))
    assert e.index_path(repo)["deleted"] == 1
    sh(repo, "checkout", "-qb", "topic")
    put(repo, {"a.txt": "topic alpha"})
    sh(repo, "commit", "-qam", "3")
    e.index_path(repo)
    assert {r.content for r in e.store.table("file_blobs").collect()} >= {"alpha", "topic alpha"}
    assert e.read_source(path="a.txt", branch="main")["content"] == "alpha" and e.read_source(path="a.txt", branch="topic")["content"] == "topic alpha"
    sh(repo, "checkout", "-q", "main"), sh(repo, "branch", "-qD", "topic")
    put(repo, {"e.txt": "e"})
    e.index_path(repo)
    assert {r.ref_name for r in e.store.table("source_views").collect()} == {"main"}


def test_committed_tree_is_read_as_checked_out(spark, tmp_path):
    repo, bare = str(tmp_path / "repo"), str(tmp_path / "bare.git")
    os.makedirs(repo)
    sh(repo, "init", "-q", "-b", "main")
    put(repo, {f"s/d{i % 3}/f {i}.txt": f"line {i}\n" * (i + 1) for i in range(40)} | {"top.md": "# é", "empty.txt": "", "node_modules/m.js": "x", "p.png": "y", "s/x.log": "z", "big.txt": "x" * (1 << 20) + "y", ".gitignore": "*.log\n"})
    os.symlink("top.md", os.path.join(repo, "link.md"))
    sh(repo, "add", "-f", "."), sh(repo, "commit", "-qm", "1")
    first = git_tree.commit_of(repo, "main")
    os.remove(os.path.join(repo, "link.md"))
    rows = lambda df: sorted((r.path, r.content) for r in df.collect())
    want = rows(scan(spark, repo)[0])
    files, excluded = git_tree.scan(spark, repo, first)  # loose objects
    assert len(want) == 41 and "empty.txt" not in dict(want) and rows(files) == want and {r.path for r in excluded.collect()} >= {"p.png", "s/x.log", "big.txt"}
    put(repo, {"top.md": "# other", "s/new.txt": "n", "s/d0/f 0.txt": "line 0\nmore\n"})
    os.remove(os.path.join(repo, "s/d1/f 1.txt"))
    sh(repo, "rm", "-q", "--cached", "link.md"), sh(repo, "add", "-A"), sh(repo, "commit", "-qm", "2"), sh(repo, "gc", "-q")
    second = git_tree.fetch("file://" + repo, "main", bare)
    assert second == git_tree.commit_of(repo, "main") and git_tree.fetch("file://" + repo, "main", bare) == second
    for root in (repo, bare):  # packed objects
        assert rows(git_tree.scan(spark, root, second)[0]) == rows(scan(spark, repo)[0])
    assert rows(git_tree.scan(spark, bare, second, "s/d2", ["**/*.txt"])[0]) == rows(scan(spark, os.path.join(repo, "s/d2"))[0])
    assert {r.path for r in git_tree.changed(spark, repo, first, second).collect()} == {"top.md", "s/new.txt", "s/d0/f 0.txt", "s/d1/f 1.txt"}
    assert not git_tree.has_commit(bare, first) and git_tree.has_commit(repo, first)
    with pytest.raises(Exception, match="no object"):
        git_tree.contents(spark.createDataFrame([("a", "0" * 40, 1)], "path string, oid string, size long"), repo).collect()
    with pytest.raises(RuntimeError):
        git_tree.tree(spark, repo, second, "nowhere")


def test_index_commits_without_checkout(spark, tmp_path):
    repo = str(tmp_path / "repo")
    os.makedirs(repo)
    sh(repo, "init", "-q", "-b", "main")
    put(repo, {"a.txt": "alpha", "s/b.txt": "beta", "s/c.txt": "gamma"})
    sh(repo, "add", "."), sh(repo, "commit", "-qm", "1")
    put(repo, {"a.txt": "not committed"})
    e = Engine(spark, str(tmp_path / "store"))
    index = lambda: e.index_git("file://" + repo, committed=True, name="r")
    got = index()
    assert (got["strategy"], got["new"]) == ("full", 3) and index()["strategy"] == "skip"
    assert e.read_source(path="a.txt")["content"] == "alpha"
    sh(repo, "checkout", "-q", "a.txt"), put(repo, {"s/b.txt": "changed", "d.txt": "delta"}), os.remove(os.path.join(repo, "s/c.txt"))
    sh(repo, "add", "-A"), sh(repo, "commit", "-qm", "2")
    got = index()
    assert (got["strategy"], got["new"], got["deleted"], got["unchanged"]) == ("diff", 2, 1, 0)
    assert {r.path for r in e.store.table("indexed_files").collect()} == {"a.txt", "s/b.txt", "d.txt"}
    direct = Engine(spark, str(tmp_path / "other"))
    assert direct.index_commit(repo, "main", "r")["new"] == 3 and direct.index_commit(repo, "main", "r")["strategy"] == "skip"
    assert direct.index_commit(repo, git_tree.commit_of(repo, "main"), "r")["new"] == 3  # a detached view beside the branch
    assert {r.view_kind for r in direct.store.table("source_views").collect()} == {"branch", "detached"}
    below = Engine(spark, str(tmp_path / "below"))
    assert below.index_commit(repo, "main", "r", subpath="s")["new"] == 1 and below.read_source(path="b.txt")["content"] == "changed"


def test_git_helpers(tmp_path):
    assert git.repo_name("https://h/u/r.git") == "r" and git.repo_name("git@h:u/r") == "r" and git.expand_home("~/x").endswith("/x")
    repo = str(tmp_path / "r")
    os.makedirs(repo)
    assert git.context(repo) == (repo, None) and git.snapshot(repo).kind == "workspace" and not git.is_ancestor(repo, "x")
    sh(repo, "init", "-q", "-b", "main")
    put(repo, {"s/a.txt": "1", "b.txt": "2"})
    sh(repo, "add", "."), sh(repo, "commit", "-qm", "1")
    assert git.context(os.path.join(repo, "s"))[1] == "s" and git.current_ref(repo) == ("branch", "main") and git.branches(repo) == ["main"]
    put(repo, {"s/a.txt": "2", "s/n.txt": "3", "b.txt": "4"})
    assert git.worktree_paths(repo, "s") == ["a.txt"] and git.untracked_paths(repo, "s") == ["n.txt"] and git.snapshot(os.path.join(repo, "s")).dirty
    sh(repo, "checkout", "-q", "--detach")
    assert git.current_ref(repo)[0] == "detached"
    clone = git.clone_or_pull("file://" + repo, "main", str(tmp_path / "c" / "r"))
    assert os.path.isfile(os.path.join(clone, "b.txt")) and git.clone_or_pull("file://" + repo, "main", clone) == clone


@pytest.mark.parametrize(
    "before,now,want",
    [
        (None, dict(tree="t"), "full"), (dict(tree="t"), dict(tree="t"), "skip"), (dict(tree="t"), dict(tree="u"), "diff"), (dict(tree="t", dirty=True), dict(tree="t"), "full"), (dict(tree="t"), dict(tree="t", dirty=True, fingerprint="f"), "diff"),
        (dict(tree="t", dirty=True, fingerprint="f"), dict(tree="t", dirty=True, fingerprint="f"), "skip"), (dict(fingerprint="w"), dict(fingerprint="w"), "skip"), (dict(fingerprint="w"), dict(fingerprint="v"), "full"), (dict(tree="t", subtree="s"), dict(tree="u", subtree="s"), "skip"),
    ],
)
def test_strategy(before, now, want):
    assert changes.strategy(before and changes.ViewState(**before), changes.ViewState(**now)) == want


def test_config(tmp_path):
    p = tmp_path / "lodeseek.yaml"
    p.write_text("sources:\n- {name: a, type: local, path: '${HERE}/x'}\nsearch: {finalTopK: 3}\n")
    c = config.load(env={"HERE": "/h"}, cwd=str(tmp_path))
    assert c["sources"][0]["path"] == "/h/x" and c["search"]["finalTopK"] == 3 and c["search"]["retrieveTopK"] == 50
    assert config.substituted("${NOPE}", {}) == "${NOPE}" and config.find(None, {"LODESEEK_CONFIG": "z"}) == "z" and config.find("q", {}) == "q"
    with pytest.raises(ValueError):
        config.checked(config.merged(config.DEFAULTS, {"search": {"useSummaryVector": True, "summaryVectorWeight": 0.5}}))
    config.copied(str(p), str(tmp_path / "copy"))
    assert "${HERE}" in (tmp_path / "copy").read_text()


def test_cli(spark, tmp_path, capsys):
    put(str(tmp_path / "src"), {"a.txt": "alpha beta"})
    store = ["--store", str(tmp_path / "store")]
    assert main([*store, "init"], spark) == 0 and main([*store, "index", "--path", str(tmp_path / "src")], spark) == 0
    assert main([*store, "search", "alpha"], spark) == 0 and "a.txt" in capsys.readouterr().out
    assert main([*store, "status"], spark) == 0 and main([*store, "list"], spark) == 0 and main([*store, "remove", "src"], spark) == 0
    assert main([*store, "search", "alpha", "--top-k", "500"], spark) == 1


# --- operators ---


def test_upsert_is_null_safe(spark):
    old = spark.createDataFrame([("1", None, 1), ("2", "b", 1)], "id string, k string, v int")
    new = spark.createDataFrame([("9", None, 5), ("3", "c", 5)], "id string, k string, v int")
    assert {tuple(r) for r in maintenance.upsert(old, new, ["k"]).collect()} == {("1", None, 5), ("2", "b", 1), ("3", "c", 5)}


def test_stale_branches(spark):
    v = spark.createDataFrame([("1", "s", "branch", "a"), ("2", "s", "branch", "b"), ("3", "s", "workspace", None), ("4", "t", "branch", "b")], "id string, source_id string, view_kind string, ref_name string")
    assert {r.id for r in maintenance.stale_branches(v, "s", ["a"]).collect()} == {"2"} and {r.id for r in maintenance.stale_branches(v, "s", []).collect()} == {"1", "2"}


def test_golden_set(spark):
    q = {"query": "x", "category": "c", "expected": [{"path": "./a.ts", "startLine": 3, "endLine": 5}]}
    queries = evaluation.validated({"version": 2, "source": "s", "queries": [q, q | {"category": "d"}]})
    for bad in ({"version": 1}, {"version": 2, "source": "s", "queries": [q | {"expected": []}]}, {"version": 2, "source": "s", "queries": [q | {"expected": [{"path": "a", "startLine": 5, "endLine": 3}]}]}):
        with pytest.raises(ValueError):
            evaluation.validated(bad)
    results = spark.createDataFrame([(0, "a.ts", 1, 2, 1), (0, "a.ts", 5, 9, 2), (1, "b.ts", 3, 5, 1)], "query_id int, path string, start_line int, end_line int, rank int")
    got = {r.category: r for r in evaluation.evaluated(results, evaluation.expectations(spark, queries)).collect()}
    assert got["all"].recall_5 == 0.5 and got["all"].mrr == 0.25 and got["c"].mrr == 0.5 and got["d"].recall_10 == 0
    m = evaluation.evaluated(results, evaluation.expectations(spark, queries))
    assert {r.delta_mrr for r in evaluation.compared(m, m).collect()} == {0.0}


def test_batch_search_is_search(spark, engine):
    t = engine.store.tables()
    q = spark.createDataFrame([("q1", "alpha beta", engine.embedder.query("alpha beta")), ("q2", "delta", engine.embedder.query("delta"))], "query_id string, query string, embedding array<float>")
    got = search.search_batch(t["chunk_contents"], q, 10).collect()
    for name, text in (("q1", "alpha beta"), ("q2", "delta")):
        one = search.candidates(t["chunks"], t["chunk_contents"], text, engine.embedder.query(text), search.Scope(), search.Options(retrieve=10), False).collect()
        assert {r.id: (round(r.fused, 6), r.text_score) for r in got if r.query_id == name} == {r.id: (round(r.fused, 6), r.text_score) for r in one}


def test_many_searches_are_single_ones(spark, tmp_path):
    """Queries with branches, sources, types and prefixes of their own give what one search each gives."""
    import random

    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", *(f"w{i}" for i in range(30))]
    files = lambda seed: [(f"{rng.choice('abc')}/{i}.{rng.choice(['txt', 'md'])}", " ".join(rng.choice(words) for _ in range(30))) for i in range(50)]
    e = Engine(spark, str(tmp_path / "s"))
    for name, ref in (("one", "old"), ("one", "main"), ("two", "main"), ("two", None)):
        e.index_documents(name, frame(spark, files(name)), ref)
    scopes = [{}, {"branch": "main"}, {"branch": "old", "source_name": "one"}, {"source_type": "markdown"}, {"path_prefix": "b/"}, {"branch": "main", "source_name": "two", "path_prefix": "a/", "source_type": "text"}, {"branch": "nowhere"}]
    asked = [(i, rng.choice(["alpha beta", "gamma", "w3 w4", "delta alpha", "..."]), s) for i, s in enumerate(scopes * 2)]
    q = spark.createDataFrame([(i, text, e.embedder.query(text), *[s.get(c) for c in ("branch", "source_name", "source_type", "path_prefix")]) for i, text, s in asked], "query_id int, query string, embedding array<float>, branch string, source_name string, source_type string, path_prefix string")
    got = {}
    for r in e.search_many(q, 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.path, r.source_name, round(r.fused, 6), r.text_score))
    for i, text, s in asked:
        want = [(r.place, r.path, r.source_name, round(r.scores.fused, 6), r.scores.text) for r in e.search(text, 10, **s).collect()]
        assert sorted(got.get(i, [])) == sorted(want), (text, s)


# --- streaming ---


def test_stream_in_any_order(spark, tmp_path):
    """Versions that come late, twice, and after deletions: every order gives the newest of each path."""
    import random

    schema = "source string, path string, content string, version long"
    feed = [("s", f"{p}.txt", None if (p + v) % 4 == 0 else f"text {p} {v}", v) for p in range(6) for v in range(1, 5)] + [("t", "0.txt", "other", 1)]
    want = {("s", f"{p}.txt", f"text {p} 4") for p in range(6) if (p + 4) % 4} | {("t", "0.txt", "other")}
    for seed in (1, 2):
        rng = random.Random(seed)
        rows = feed + rng.sample(feed, 8)
        rng.shuffle(rows)
        folder, e = tmp_path / f"feed{seed}", Engine(spark, str(tmp_path / f"store{seed}"))
        for k in range(4):
            spark.createDataFrame(rows[k::4], schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        ingest.ingest(stream, e, str(tmp_path / f"check{seed}")).awaitTermination(300)
        t = e.store.tables()
        f = t["indexed_files"].join(t["file_blobs"], "content_hash").join(t["source_views"].selectExpr("id as source_view_id", "source_id"), "source_view_id").join(t["sources"].selectExpr("id as source_id", "name"), "source_id")
        assert {(r.name, r.path, r.content) for r in f.select("name", "path", "content").collect()} == want
        assert e.store.table("versions").where("gone").count() == sum((p + 4) % 4 == 0 for p in range(6))
        assert e.forget_versions(4) == 0 and e.forget_versions(5) == 2 and e.store.table("versions").count() == 5


def test_stream_into_store(spark, tmp_path, engine):
    feed, check = str(tmp_path / "feed"), str(tmp_path / "check")
    schema = "source string, path string, content string, version long"
    spark.createDataFrame([("docs", "a.txt", "old", 1), ("docs", "a.txt", "newest words", 2), ("docs", "b.md", None, 2), ("fresh", "n.txt", "n", 1)], schema).write.parquet(feed)
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(spark.readStream.schema(schema).parquet(feed), engine, check).awaitTermination(120)
    assert engine.read_source(path="a.txt", source_name="docs")["content"] == "newest words"
    assert {r.path for r in engine.store.table("indexed_files").collect()} == {"a.txt", "c.java", "n.txt"}


def test_windowed_feed(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.select("ts", "event_type", "value").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    q = ingest.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("feed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = events.groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").count()
    assert spark.table("feed").count() == want.count() and spark.table("feed").agg(F.sum("n")).first()[0] == events.count()
