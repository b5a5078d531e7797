from __future__ import annotations

import json
import os
import subprocess
import time
import warnings

import pytest
from pyspark.sql import functions as F

from mnemospark.engine import MemoryEngine
from mnemospark.functions.embed import HashingEmbedder
from mnemospark.operators.store import Store, changed, last_writer, stale
from mnemospark.settings import Settings
from mnemospark.sources import files, git
from mnemospark.streaming.watch import changes, watch


@pytest.fixture
def repo(tmp_path):
    r = tmp_path / "proj"
    r.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(r), "-c", "user.name=n", "-c", "user.email=e@x.invalid", *a], check=True, capture_output=True)
    run("init", "-q")
    (r / "__init__.py").write_text("def zebra():\n    return 1\n")
    (r / "big.py").write_text("\n".join(f"line {i}" for i in range(150)))
    (r / "pic.png").write_bytes(b"\x89PNG\x00")
    (r / "skip.env").write_text("A=1")
    (r / ".memoryignore").write_text("# comment\n*.env\nbuild/\n")
    run("add", "-A")
    run("commit", "-q", "-m", "Add zebra handling")
    return r, run


def write_claude(folder, extra=()):
    folder.mkdir(exist_ok=True)
    rows = [
        {"type": "ai-title", "aiTitle": "Zebra work"},
        {"type": "user", "message": {"content": "How do I feed the zebra?"}, "timestamp": "2026-01-02T03:04:05Z", "cwd": "/nowhere/proj", "sessionId": "s1"},
        {"type": "assistant", "message": {"content": [{"type": "text", "text": "Use hay. password = hunter2222"}, {"type": "tool_use", "name": "Edit", "input": {"file_path": "a.py"}}]}},
        *extra,
    ]
    (folder / "one.jsonl").write_text("\n".join(["not json", *map(json.dumps, rows), "[1]"]))


def test_end_to_end(spark, tmp_path, repo):
    r, run = repo
    e = MemoryEngine(spark, str(tmp_path / "home"), hashing=True)
    assert e.recall("zebra").startswith("The index is empty")
    logs = tmp_path / "logs"
    write_claude(logs)
    first = e.index("all", str(r), {"claude": str(logs)})
    assert first["agent"] == {"turns": 1, "files": 1, "skipped": 0} and first["commits"] == {"commits": 1}
    assert first["code"]["files"] == 3 and first["code"]["pruned"] == 0  # __init__.py, big.py, .memoryignore
    again = e.index("all", str(r), {"claude": str(logs)})
    assert again["agent"]["skipped"] == 1 and again["code"]["files"] == 0 and changes(again) == {"turns": 0, "chunks": 0, "commits": 0}
    text = e.recall("zebra", repo="all")
    assert "session:Zebra work" in text and "Add zebra handling" in text and "hunter2222" not in text and "«REDACTED:SECRET»" in text
    assert e.recall("zebra", repo="elsewhere").startswith("No relevant memory")
    (r / "big.py").write_text("def giraffe():\n    pass\n")
    (r / "__init__.py").unlink()
    run("add", "-A")
    run("commit", "-q", "-m", "Second")
    third = e.index("all", str(r), {"claude": str(logs)})
    assert third["code"] == {"files": 1, "chunks": 1, "skipped": 1, "pruned": 1} and third["commits"] == {"commits": 1}
    assert {x["path"] for x in e.store.paths("code", "proj").collect()} == {"big.py", ".memoryignore"}
    assert e.remember("Zebras sleep standing.\nsecond line", "proj") == "Zebras sleep standing." and e.remember("  ") is None
    n = {(x["dimension"], x["value"]): x["n"] for x in e.stats().collect()}
    assert n["source_type", "note"] == 1 and n["agent", "claude"] == 1 and n["total", ""] == e.documents().count()
    assert "note " in e.recall("standing", since="1d") and e.last_time() is not None
    gone = e.forget("proj")
    assert gone["documents"] > 3 and gone["states"] == 3 and e.documents().where("repo = 'proj'").count() == 0
    e.views()
    assert spark.sql("select count(*) from memory_documents").first()[0] == e.documents().count()
    assert e.reset() == 0 or e.documents().isEmpty()


def test_commit_logs_of_all_directories(spark, tmp_path, repo, monkeypatch):
    r, run = repo
    (tmp_path / "plain").mkdir()
    turns = spark.range(10_050).select(F.concat(F.lit("/nowhere/"), "id").alias("cwd"))
    turns = turns.unionAll(spark.createDataFrame([(str(r),), (str(r),), (str(tmp_path / "plain"),), ("",), (None,)], "cwd string"))
    e = MemoryEngine(spark, str(tmp_path / "home"))
    for batch in (1, 2_000):
        monkeypatch.setattr("mnemospark.engine.LOG_BATCH", batch)
        assert [(x["cwd"], x["subject"]) for x in e._commit_logs(turns).collect()] == [(str(r), "Add zebra handling")]
    assert e._commit_logs(turns.limit(0)).count() == 0


def test_store_versions(spark, tmp_path):
    e = MemoryEngine(spark, str(tmp_path / "h"), masked=False)
    docs = lambda *rows: spark.createDataFrame(list(rows), "id string, source_type string, repo string, path string, title string, text string, version long")
    vec = lambda i: spark.createDataFrame([(i, [1.0, 2.0], "m")], "doc_id string, vec array<float>, model_id string")
    assert e.store.upsert(docs(("a", "note", "r", "p", "t", "one two", 1), ("b", "note", "r", "p", "t", "two", 1)), False, vec("a")) == 2
    assert e.store.upsert(docs(("a", "note", "r", "p", "t", "old", 1), ("a", "note", "r", "p", "t", "new", 2), (None, "note", "r", "p", "t", "x", 1)), False) == 1
    assert e.store.get("a").first()["text"] == "new" and e.store.read("vectors").count() == 0  # its text changed
    assert {x["token"] for x in e.store.read("postings").where("doc_id = 'a' and field = 'text'").collect()} == {"new"}
    e.store.set_states({"k": "1", "l": "2"})
    e.store.set_states({"k": "3"})
    e.store.delete_states(["l"])
    assert e.store.get_state("k") == "3" and e.store.get_state("l") is None
    assert e.store.delete_by_path("note", "r", "zz") == 0 and e.store.delete_by_path("note", "r", "p") == 2
    e.store.upsert(docs(("s", "note", "r", "p", "t", "password=abcdefgh", 1)), False, vec("s"))
    assert e.store.rescan() == 1 and e.store.rescan() == 0 and e.store.read("vectors").count() == 1
    legacy = spark.createDataFrame([("x", "[1, 2.5]"), ("y", "oops")], "doc_id string, vec_json string")
    assert e.store.migrate_vectors(legacy) == 1


def test_manifests(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("n", None)], "k string, v string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4"), ("n", None)], "k string, v string")
    assert sorted(r["k"] for r in changed(old, new, "k", "v").collect()) == ["b", "c"]
    assert [r["k"] for r in stale(new, old, "k").collect()] == ["c"]
    assert sorted(map(tuple, last_writer(old, new, "k").collect()), key=str) == sorted(map(tuple, new.collect()), key=str)


def test_ignore_patterns(spark):
    paths = ["a.env", "x/b.env", "secrets/k", "x/secrets/k", "docs/a.md", "q.md"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    pats = files.ignore_patterns("*.env\n# no\n\nsecrets/\ndocs/a.md\n")
    assert [r[0] for r in df.select(files.is_ignored(F.col("p"), pats)).collect()] == [True, True, True, False, True, False]
    assert not any(r[0] for r in df.select(files.is_ignored(F.col("p"), [])).collect())


def test_codex_and_gemini_files(spark, tmp_path):
    d = tmp_path / "codex" / "2026" / "01"
    d.mkdir(parents=True)
    rows = [
        {"type": "session_meta", "payload": {"cwd": "/w/app", "git": {"branch": "dev"}}},
        {"timestamp": "2026-01-01T00:00:00Z", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "Why?"}]}},
        {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "Because."}]}},
    ]
    (d / "rollout-x.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (d / "other.jsonl").write_text(json.dumps(rows[1]))
    g = tmp_path / "gemini" / "p1" / "chats"
    g.mkdir(parents=True)
    (g.parent / ".project_root").write_text("/w/gem\n")
    chat = [{"sessionId": "z"}, {"type": "user", "content": [{"text": "Hm?"}]}, {"type": "gemini", "content": "Yes.", "toolCalls": [{"name": "ls", "args": {"dir_path": "/d"}}]}]
    (g / "session-1.jsonl").write_text("\n".join(map(json.dumps, chat)))
    e = MemoryEngine(spark, str(tmp_path / "h2"))
    assert e.index("agent", session_roots={"codex": str(tmp_path / "codex"), "gemini": str(tmp_path / "gemini"), "claude": str(tmp_path / "none")})["agent"] == {"turns": 2, "files": 2, "skipped": 0}
    got = {r["agent"]: (r["question"], r["answer"], r["repo"], r["branch"], r["files"]) for r in e.documents().collect()}
    assert got == {"codex": ("Why?", "Because.", "app", "dev", []), "gemini": ("Hm?", "Yes.", "gem", "", ["/d"])}


def test_git_helpers(tmp_path, repo):
    r, _ = repo
    assert git.repo_name(str(r)) == "proj" and git.repo_name(str(tmp_path), inside_only=True) is None and git.tracked_files(str(tmp_path)) == []
    sha = git.head(str(r))
    assert git.patch(str(r), sha, 3).endswith("more lines truncated)") and git.patch(str(r), "nope") is None


def test_watch(spark, tmp_path):
    seen, results = [], [{"commits": {"commits": 0}}, {"code": {"chunks": 2}}]
    q = watch(spark, lambda: results.pop() if results else {}, str(tmp_path / "cp"), 1, seen.append)
    for _ in range(60):
        if seen and not results:
            break
        time.sleep(0.5)
    q.stop()
    assert seen == [{"turns": 0, "chunks": 2, "commits": 0}]


def _notes(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, source_type string, repo string, path string, title string, text string, version long")


def test_a_failed_write_changes_nothing(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "s"))
    s.upsert(_notes(spark, ("a", "note", "r", "p", "t", "one", 1), ("b", "note", "r", "p", "t", "two", 1)), False)
    for step in ("_point", "_bucket"):  # after all files are written, and before any

        def stop(*_):
            raise OSError("stopped")

        with monkeypatch.context() as m:
            m.setattr(Store, step, stop)
            with pytest.raises(OSError):
                s.upsert(_notes(spark, ("a", "note", "r", "p", "t", "three", 2)), False)
        assert s.get("a").first()["text"] == "one" and {r["token"] for r in s.read("postings").where("field = 'text'").collect()} == {"one", "two"}
    assert s.upsert(_notes(spark, ("a", "note", "r", "p", "t", "four", 3)), False) == 1 and s.get("a").first()["text"] == "four" and s.read("documents").count() == 2


def test_nothing_is_deleted_without_a_pointer(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.upsert(_notes(spark, ("a", "note", "r", "p", "t", "one", 1)), False)
    current = (tmp_path / "s" / "CURRENT").read_text()
    (tmp_path / "s" / "CURRENT").unlink()
    with pytest.raises(RuntimeError):
        s.upsert(_notes(spark, ("b", "note", "r", "p", "t", "two", 1)), False)
    (tmp_path / "s" / "CURRENT").write_text(current)
    assert s.get("a").first()["text"] == "one"


def test_an_upsert_writes_only_its_buckets_and_they_multiply(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "s"))
    s.upsert(_notes(spark, *[(f"n{k}", "note", "r", "p", "t", f"word{k}", 1) for k in range(60)]), False)
    before = s._manifest()
    s.upsert(_notes(spark, ("n7", "note", "r", "p", "t", "changed", 2)), False)
    after = s._manifest()
    assert sum(before["tables"]["documents"][b] != v for b, v in after["tables"]["documents"].items()) == 1 and after["rows"] == 60
    monkeypatch.setattr("mnemospark.operators.store.BUCKET_DOCUMENTS", 3)
    s.upsert(_notes(spark, ("x", "note", "r", "p", "t", "more", 1)), False)
    assert s._manifest()["buckets"] == 64 and s.read("documents").count() == 61 and s.get("n7").first()["text"] == "changed"
    assert s.forget_repo("r")["documents"] == 61 and s.read("postings").isEmpty() and s._manifest()["rows"] == 0


def test_a_manifest_opens_no_file(spark, tmp_path):
    os.mkfifo(tmp_path / "pipe.jsonl")  # opening it would wait for a writer
    (tmp_path / "a.jsonl").write_text("{}")
    assert files._file(str(tmp_path), "pipe.jsonl", False)[0] == "pipe.jsonl"
    assert sorted(r["path"] for r in files.manifest(spark, str(tmp_path), "*.jsonl").collect()) == ["a.jsonl", "pipe.jsonl"]
    one = files.read_files(spark.createDataFrame([("a.jsonl",), ("gone",)], "path string"), str(tmp_path)).collect()
    assert [(r["path"], bytes(r["content"])) for r in one] == [("a.jsonl", b"{}")]


def test_settings(spark, tmp_path, monkeypatch):
    for k, v in {"HOME": str(tmp_path / "h"), "CODEX_SESSIONS": "/x", "REDACT_ENTROPY": "Yes", "WORK_PENALTY": "3", "EMBED_BACKEND": "none"}.items():
        monkeypatch.setenv(f"MNEMOSPARK_{k}", v)
    c = Settings()
    assert c.sessions["codex"] == "/x" and c.sessions["claude"].endswith(".claude/projects") and c.work_penalty == 3 and c.commit_window_min == 180
    e = MemoryEngine(spark, hashing=True)
    assert e.embedder is None and e.store.home == str(tmp_path / "h")
    e.remember("the value is aB3dE5gH7jK9mN1pQ3sT5vX7zY2wU4rO6 today", "r")
    assert "HIGH_ENTROPY" in e.documents().first()["text"]


def test_vectors_of_another_model(spark, tmp_path):
    e = MemoryEngine(spark, str(tmp_path / "h"))
    e.remember("zebras sleep standing", "r")
    e.embedder = HashingEmbedder(8)
    assert e.fill_vectors() == 1 and e.fill_vectors() == 0 and e.store.embedder_id() == "hashing:8"
    other = MemoryEngine(spark, str(tmp_path / "h"), embedder=HashingEmbedder(16))
    with pytest.warns(UserWarning, match="hashing:8"):
        assert other.search("zebras").count() == 1
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert other.search("zebras").count() == 1  # said once
