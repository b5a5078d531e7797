"""The engine: index, recall, remember, statistics and forgetting over one home folder."""

from __future__ import annotations

import os
import warnings
from datetime import UTC, datetime
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.embed import Embedder, HashingEmbedder, embed, fill_missing
from .functions.instants import add_instant
from .functions.text import first_line, is_indexable, make_id, strip
from .operators import search, sessions
from .operators.chunking import code_documents
from .operators.linking import link_commits
from .operators.store import COMMIT, DOCUMENT, Store, changed, stale
from .plans import render
from .session import cut
from .settings import Settings
from .sources import files, git

#: Directories whose commit logs one job reads; all are read, batch after batch.
LOG_BATCH = 2_000
STATE_PREFIX = {"claude": "agent", "codex": "codex", "gemini": "gemini"}


class MemoryEngine:
    """A document memory. Without an embedder (and without ``hashing``) there are no vectors; ``masked=False`` stores
    secrets as they are; ``settings`` that are not given come from the environment."""

    def __init__(
        self, spark: SparkSession, home: str | None = None, embedder: Embedder | None = None, masked: bool = True, hashing: bool = False, settings: Settings | None = None
    ):
        self.settings = settings or Settings()
        self.spark, self.store, self.masked = spark, Store(spark, home or self.settings.home), masked
        self.embedder = embedder or (HashingEmbedder() if hashing and self.settings.embed_backend != "none" else None)
        self._warned = False

    # -- writing ----------------------------------------------------------------------------------------------
    def _put(self, docs: DataFrame) -> int:
        from .functions.redact import redact_columns

        entropy = self.settings.redact_entropy
        docs = redact_columns(docs, ["text"], high_entropy=entropy).drop("n_masked") if self.masked else docs  # vectors are made of masked text
        docs = cut(docs)
        vectors = None
        if self.embedder:
            vectors = embed(docs, self.embedder)
            if self.store.embedder_id() != self.embedder.model_id:
                self.store.set_states({Store.MODEL: self.embedder.model_id})
        return self.store.upsert(docs, self.masked, vectors, entropy)

    def fill_vectors(self) -> int:
        """Embeds the documents that have no vector of the embedder's model; returns their number."""
        if not self.embedder:
            return 0
        made = cut(fill_missing(self.documents(), self.store.read("vectors"), self.embedder).where("vec is not null"))
        n = made.count()
        if n:
            self.store.put_vectors(made)
            self.store.set_states({Store.MODEL: self.embedder.model_id})
        return n

    def _mislead(self) -> bool:
        """Whether the stored vectors are of another model than the embedder's; warns of that once."""
        stored = self.store.embedder_id()
        if stored in (None, self.embedder.model_id):
            return False
        if not self._warned:
            self._warned = True
            warnings.warn(f"vectors were made by {stored}, not {self.embedder.model_id}: searching text alone until the index is made again", stacklevel=3)
        return True

    def index_sessions(self, agent: str, root: str, reindex: bool = False) -> dict[str, int]:
        """Indexes the session files of an agent that changed since the last pass; {turns, files, skipped}."""
        if not os.path.isdir(root):
            return {"turns": 0, "files": 0, "skipped": 0}
        prefix = STATE_PREFIX[agent]
        manifest = files.manifest(self.spark, root, files.SESSION_FILES[agent])
        if agent == "gemini":
            manifest = manifest.where(F.size(F.split("path", "/")) == 3)
        new = cut(manifest.select("path", F.concat(F.lit(f"{prefix}:{root.rstrip('/')}/"), "path").alias("key"), F.col("mtime").cast("string").alias("value")))
        work = new if reindex else changed(self.store.read("index_state"), new, "key", "value")
        work = cut(work)
        n = work.count()
        if n:
            records = files.session_records(self.spark, agent, root, work)
            turns = self._turn_documents(sessions.assemble(sessions.READERS[agent](records), "path"))
            count = self._put(turns)
            self.store.set_states(work.select("key", "value"))
        else:
            count = 0
        return {"turns": count, "files": n, "skipped": new.count() - n}

    def _turn_documents(self, turns: DataFrame) -> DataFrame:
        t = add_instant(turns, "started", "t")
        t = t.withColumns(sessions.turn_columns())
        key = make_id("agent_turn", F.col("session_id"), F.col("t"), F.substring("question", 1, 120))
        t = cut(t.withColumn("id", key))
        log = self._commit_logs(t).withColumn("t", F.unix_micros("committed_at"))
        links = link_commits(t.select(F.col("id").alias("turn_id"), "cwd", "t", "files"), log, self.settings.commit_window_min)
        linked = links.groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("rank", "short_sha", "subject", "kind"))).alias("l"))
        as_commits = F.transform("l", lambda x: F.struct(x["short_sha"].alias("hash"), x["subject"].alias("subject"), x["kind"].alias("kind")))
        out = t.join(linked.select(F.col("turn_id").alias("id"), as_commits.cast(COMMIT).alias("commits")), "id", "left")
        return out.select(
            "id", F.lit("agent_turn").alias("source_type"), "repo", F.col("session_id").alias("path"), "title", "text", F.timestamp_micros("t").alias("ts"), "question", "answer",
            "answer_summary", "branch", "cwd", "tools", "files", "session_title", "session_id", "commits", "agent",
        )

    def _commit_logs(self, turns: DataFrame) -> DataFrame:
        """The commits of every existing directory of ``turns``, read LOG_BATCH directories at a time."""
        named = turns.select("cwd").where("cwd <> ''").distinct().toLocalIterator()
        there = iter([r["cwd"] for r in named if os.path.isdir(r["cwd"])])
        logs = [cut(git.commit_log(self.spark, part, all_branches=True)) for part in iter(lambda: list(islice(there, LOG_BATCH)), [])]
        return reduce(DataFrame.unionAll, logs) if logs else git.commit_log(self.spark, [], all_branches=True)

    def index_code(self, repo_path: str, reindex: bool = False, prune: bool = True, ignore: str = "") -> dict[str, int]:
        """Indexes the tracked files of a repository whose content changed; {files, chunks, skipped, pruned}."""
        repo = os.path.basename(os.path.realpath(repo_path))
        tracked = git.tracked_files(repo_path)
        listed = self.spark.createDataFrame([(p,) for p in tracked], "path string")
        own = os.path.join(repo_path, ".memoryignore")
        patterns = files.ignore_patterns(open(own, encoding="utf-8").read() if os.path.exists(own) else "", ignore)
        all_ = files.raw_files(self.spark, repo_path).join(listed, "path", "left_semi").where(~files.is_ignored(F.col("path"), patterns))
        current = cut(all_.where(is_indexable(F.col("path"), F.col("size"), F.col("content"))).select(F.lit(repo).alias("repo"), "path", "sha1", files.text_of(F.col("content")).alias("text")))
        state = self.store.read("index_state")
        keyed = current.select("path", F.concat(F.lit(f"code:{repo}:"), "path").alias("key"), F.col("sha1").alias("value"))
        work = cut(keyed if reindex else changed(state, keyed, "key", "value"))
        n = work.count()
        chunks = 0
        if n:
            self.store.delete_paths("code", repo, work.select("path"))
            docs = code_documents(current.join(work.select("path"), "path", "left_semi"))
            chunks = self._put(docs.withColumn("root", F.lit(os.path.realpath(repo_path))))
            self.store.set_states(work.select("key", "value"))
        pruned = 0
        if prune:
            known = self.store.read("index_state").where(F.col("key").startswith(f"code:{repo}:")).select(F.expr(f"substring(key, {len(repo) + 7})").alias("path"))
            gone = cut(stale(known, current, "path"))
            pruned = gone.count()
            if pruned:
                self.store.delete_paths("code", repo, gone)
                kept = self.store.read("index_state").join(gone.select(F.concat(F.lit(f"code:{repo}:"), "path").alias("key")), "key", "left_anti")
                self.store.write("index_state", kept)
        return {"files": n, "chunks": chunks, "skipped": current.count() - n, "pruned": pruned}

    def index_commits(self, repo_path: str, reindex: bool = False) -> dict[str, int]:
        """Indexes the commits since the last pass; {commits}."""
        now = git.head(repo_path)
        repo = os.path.basename(os.path.realpath(repo_path))
        last = None if reindex else self.store.get_state(f"commits:{repo}")
        if now is None or now == last:
            return {"commits": 0}
        n = self._put(git.commit_documents(git.commit_log(self.spark, [repo_path], since=last or ""), repo))
        self.store.set_states({f"commits:{repo}": now})
        return {"commits": n}

    def index(self, source: str = "all", path: str = ".", session_roots: dict[str, str] | None = None, reindex: bool = False, prune: bool = True) -> dict[str, dict[str, int]]:
        """One pass over the sources: ``agent``, ``code``, ``commits`` or ``all``. Session folders that are not given are
        those of the settings; missing vectors are made last."""
        if source not in ("agent", "code", "commits", "all"):
            raise ValueError(f"unknown source {source}")
        out: dict[str, dict[str, int]] = {}
        if source in ("agent", "all"):
            total = {"turns": 0, "files": 0, "skipped": 0}
            for agent, root in (self.settings.sessions if session_roots is None else session_roots).items():
                for k, v in self.index_sessions(agent, root, reindex).items():
                    total[k] += v
            out["agent"] = total
        if source in ("code", "all"):
            out["code"] = self.index_code(path, reindex, prune)
        if source in ("commits", "all"):
            out["commits"] = self.index_commits(path, reindex)
        self.fill_vectors()
        return out

    def remember(self, text: str, repo: str = "", when: datetime | None = None) -> str | None:
        """Stores a note and returns its title, None for a blank one."""
        text = (text or "").strip()
        if not text:
            return None
        when = when or datetime.now(UTC)
        one = self.spark.createDataFrame([(text, repo, when, when.isoformat())], "text string, repo string, ts timestamp, at string")
        docs = one.select(
            make_id("note", F.col("repo"), F.col("at"), F.col("text")).alias("id"), F.lit("note").alias("source_type"), "repo", F.lit("note").alias("path"),
            strip(first_line(F.col("text"))).alias("title"), "text", "ts",
        )
        self._put(docs)
        return text.splitlines()[0].strip()[:80]

    # -- reading ----------------------------------------------------------------------------------------------
    def documents(self) -> DataFrame:
        return self.store.read("documents")

    def views(self) -> None:
        """The tables as temporary views for SQL."""
        for name in ("documents", "postings", "doc_len", "vectors", "index_state"):
            self.store.read(name).createOrReplaceTempView(f"memory_{name}")

    def search(self, query: str, k: int = 5, repo: str | None = None, source_type: str | None = None, since: str | datetime | None = None) -> DataFrame:
        """The hits of a query: documents with ``rank`` and ``citation``."""
        docs = self.documents()
        vector, vectors = None, None
        if self.embedder and not self._mislead():
            vector = self.embedder.embed_many([query])[0]
            vectors = self.store.read("vectors").where(F.col("model_id") == self.embedder.model_id)
        cut_off = search.parse_since(since) if isinstance(since, str) else since
        hits = search.retrieve(
            docs, query, k, vectors=vectors, query_vector=vector, post=self.store.read("postings"), lengths=self.store.read("doc_len"), penalty=self.settings.work_penalty,
            repo=repo, source_type=source_type, since=cut_off,
        )
        return render.cited(docs.join(F.broadcast(hits), docs["id"] == hits["doc_id"])).orderBy("rank")  # k rows

    def recall(self, query: str, k: int = 5, repo: str | None = None, source_type: str | None = None, since: str | None = None, here: str | None = None) -> str:
        """The hits as text, or why there are none."""
        scope = search.resolve_repo(repo, here)
        if self.documents().isEmpty():
            return "The index is empty: index something first."
        hits = self.search(query, k, scope, source_type or None, since).select(render.block().alias("block")).collect()
        where = f"repo={scope}" if scope else "all repos"
        if not hits:
            return f'No relevant memory found for "{query}" ({where}).'
        head = f'{len(hits)} memory item(s) for "{query}" ({where}, with sources):'
        return "\n\n".join([head, *(h["block"] for h in hits)])

    def stats(self) -> DataFrame:
        return search.stats(self.documents())

    def last_time(self) -> datetime | None:
        """The newest document's time."""
        return self.documents().agg(F.max("ts")).first()[0]

    def forget(self, repo: str) -> dict[str, int]:
        return self.store.forget_repo(repo)

    def reset(self) -> int:
        return self.store.reset()


__all__ = ["DOCUMENT", "MemoryEngine"]
