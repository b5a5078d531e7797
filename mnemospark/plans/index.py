"""Queries over the stored index, code documents and rendered hits, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking
from ..operators.store import Store
from ..session import cut, shared_folder, table
from . import memory, render
from .memory import _D, _EXT, _STRIP, _TOKENS


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.lower(F.trim("source")).alias("source_type"), "repo", "path", "title", "text", F.lit(1).cast("long").alias("version")
    )


def _store(spark: SparkSession, sf: str) -> Store:
    """A new index of all documents in the shared folder."""
    s = Store(spark, f"{shared_folder(spark)}/stores/{uuid.uuid4().hex}")
    s.upsert(_documents(spark, sf), False)
    return s


def _indexed(s: Store) -> DataFrame:
    """(doc_id, digest, dl, tokens): every document of an index with its length and the number of its postings."""
    post = s.read("postings").groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"))
    d = s.read("documents").select(F.col("id").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    out = d.join(s.read("doc_len"), "doc_id").join(post, "doc_id", "left")
    return out.select("doc_id", "digest", F.col("dl").cast("long").alias("dl"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


_LEN = f"(len({_TOKENS.format('title')}) + len({_TOKENS.format('text')}))::BIGINT"
_BIGGEST = "(SELECT repo FROM documents WHERE repo IS NOT NULL GROUP BY repo ORDER BY count(*) DESC, repo LIMIT 1)"


def _biggest(spark: SparkSession, sf: str) -> str:
    d = table(spark, sf, "documents").where("repo is not null").groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    row = d.orderBy(F.desc("n"), "repo").first()
    return row["repo"] if row else ""


def store_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """An index of all documents after a second pass in which the text of all code has changed."""
    s = _store(spark, sf)
    s.upsert(_documents(spark, sf).where("source_type = 'code'").withColumns({"text": F.concat(F.lit("changed again "), F.coalesce("text", F.lit(""))), "version": F.lit(2).cast("long")}), False)
    return _indexed(s)


STORE_UPSERT = f"""
WITH d AS (SELECT doc_id::VARCHAR AS doc_id, title, CASE WHEN source_type = 'code' THEN 'changed again ' || coalesce(text, '') ELSE text END AS text FROM ({_D}))
SELECT doc_id, md5(coalesce(text, '')) AS digest, {_LEN} AS dl, {_LEN} AS tokens FROM d
"""


def store_forget(spark: SparkSession, sf: str) -> DataFrame:
    """An index of all documents without the biggest repository."""
    s = _store(spark, sf)
    s.forget_repo(_biggest(spark, sf))
    return _indexed(s)


STORE_FORGET = f"SELECT doc_id::VARCHAR AS doc_id, md5(coalesce(text, '')) AS digest, {_LEN} AS dl, {_LEN} AS tokens FROM documents WHERE repo IS NULL OR repo <> {_BIGGEST}"


def store_get(spark: SparkSession, sf: str) -> DataFrame:
    """One document of an index of all documents, read from its bucket."""
    return _store(spark, sf).get("17").select("id", "source_type", "repo", "title", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))


def store_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The paths of the code of the biggest repository in an index of all documents."""
    return _store(spark, sf).paths("code", _biggest(spark, sf))


def store_delete_paths(spark: SparkSession, sf: str) -> DataFrame:
    """What an index of all documents keeps when all paths of the biggest repository's code are deleted."""
    s, repo = _store(spark, sf), _biggest(spark, sf)
    s.delete_paths("code", repo, cut(s.paths("code", repo)))
    return _indexed(s)


def store_rescan(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of an index of all documents that were stored unmasked and are masked afterwards."""
    s = _store(spark, sf)
    s.rescan()
    return s.read("documents").select(F.col("id").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))


STORE_RESCAN = memory._redact_sql().replace("SELECT doc_id, md5(x) AS digest, n::BIGINT AS n_masked", "SELECT doc_id::VARCHAR AS doc_id, md5(coalesce(x, '')) AS digest").replace(" WHERE n > 0", "")


def indexable(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, ok): whether a path and its text are indexed."""
    d = table(spark, sf, "documents").where("path is not null and text is not null")
    return d.select("doc_id", X.is_indexable(F.col("path"), F.octet_length("text"), F.col("text")).alias("ok"))


_SKIPPED = ", ".join(f"'{e}'" for e in X.SKIPPED_ENDINGS)
_OK = f"({_EXT} NOT IN ({_SKIPPED}) AND octet_length(encode(text)) <= {X.MAX_BYTES} AND NOT contains(text[1:8192], chr(0)))"


def code_documents(spark: SparkSession, sf: str) -> DataFrame:
    """(id, path, title, lang, start_line, end_line, digest): the documents that the code of the table is indexed as."""
    c = chunking.code_documents(_documents(spark, sf).where("source_type = 'code' and text is not null").select("repo", "path", "text"))
    return c.select("id", "path", "title", "lang", "start_line", "end_line", F.md5(F.col("text").cast("binary")).alias("digest"))


CODE_DOCUMENTS = f"""
WITH k AS ({memory._chunk_sql()}), f AS (SELECT doc_id, repo, path, {memory._LANG} AS lang FROM (SELECT *, {_EXT} AS ext FROM ({_D})) WHERE {_OK}),
     b AS (SELECT k.*, repo, path, f.lang FROM k JOIN f USING (doc_id))
SELECT 'code:' || substr(sha1('code' || chr(0) || coalesce(repo, 'None') || chr(0) || coalesce(path, 'None') || chr(0) || start_line), 1, 16) AS id,
       path, path || ':' || start_line || '-' || end_line AS title, lang, start_line, end_line, digest FROM b WHERE NOT blank
"""
CODE_DOCUMENTS = CODE_DOCUMENTS.replace("AS digest FROM x", f"AS digest, {_STRIP.format('array_to_string(ls[p + 1:q], chr(10))')} = '' AS blank FROM x")


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """All documents and turns as hits with a rank."""
    d = _documents(spark, sf).select("id", "source_type", "repo", "path", "title", "text", F.col("id").cast("int").alias("rank"))
    t = memory._turns(spark, sf).select(
        F.concat(F.lit("t"), "turn_id").alias("id"), F.lit("agent_turn").alias("source_type"), "repo", F.lit("").alias("path"), F.col("session_title").alias("title"), F.lit("").alias("text"),
        F.col("turn_id").cast("int").alias("rank"), "question", F.col("when_ts").cast("timestamp").alias("ts"), "agent", "session_title", X.summarize(F.col("answer")).alias("answer_summary"),
    )
    return render.cited(t.unionByName(d, allowMissingColumns=True))


def citations(spark: SparkSession, sf: str) -> DataFrame:
    """(id, citation) of documents of all types and of turns."""
    return _hits(spark, sf).select("id", "citation")


_CITED = f"""
SELECT doc_id::VARCHAR AS id, source_type, text, title, NULL AS question, NULL AS answer, doc_id AS rank,
       CASE source_type WHEN 'agent_turn' THEN coalesce(repo, '') || ' ? session:' || coalesce(title, '') WHEN 'code' THEN coalesce(repo, '') || '/' || coalesce(title, '')
                        WHEN 'commit' THEN coalesce(repo, '') || '@' || coalesce(path, '') || ' "' || coalesce(title, '') || '"' WHEN 'note' THEN 'note ?' ELSE coalesce(path, '') END AS citation
FROM ({_D})
UNION ALL
SELECT 't' || turn_id, 'agent_turn', '', session_title, question, answer, turn_id,
       coalesce(repo, '') || ' ' || coalesce(strftime(make_timestamp(epoch_us(when_ts)), '%Y-%m-%d'), '?') || ' ' || CASE WHEN agent IS NOT NULL AND agent <> 'claude' THEN '[' || agent || '] ' ELSE '' END || 'session:' || coalesce(session_title, '')
FROM ({memory._T})
"""


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """(id, block): every document (none a turn) as the text of a hit."""
    return _hits(spark, sf).where("source_type <> 'agent_turn'").select("id", render.block().alias("block"))


BLOCKS = f"SELECT id, '### [' || rank || '] ' || citation || chr(10) || substr(coalesce(text, ''), 1, 400) AS block FROM ({_CITED}) WHERE source_type <> 'agent_turn'"

QUERIES = {f.__name__: f for f in (store_upsert, store_forget, store_get, store_paths, store_delete_paths, store_rescan, indexable, code_documents, citations, blocks)}
SQL = {
    "store_upsert": STORE_UPSERT, "store_forget": STORE_FORGET,
    "store_get": f"SELECT doc_id::VARCHAR AS id, source_type, repo, title, md5(coalesce(text, '')) AS digest FROM ({_D}) WHERE doc_id = 17",
    "store_paths": f"SELECT DISTINCT path FROM ({_D}) WHERE source_type = 'code' AND repo = {_BIGGEST}",
    "store_delete_paths": f"SELECT doc_id::VARCHAR AS doc_id, md5(coalesce(text, '')) AS digest, {_LEN} AS dl, {_LEN} AS tokens FROM ({_D}) WHERE NOT coalesce(source_type = 'code' AND repo = {_BIGGEST} AND path IS NOT NULL, false)",
    "store_rescan": STORE_RESCAN, "indexable": f"SELECT doc_id, {_OK} AS ok FROM documents WHERE path IS NOT NULL AND text IS NOT NULL",
    "code_documents": CODE_DOCUMENTS, "citations": f"SELECT id, citation FROM ({_CITED})", "blocks": BLOCKS,
}
