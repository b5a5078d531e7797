"""Retrieval: a positional inverted index, BM25, exact vector search, rank fusion, re-ranking and collapsing.

Indexes are ordinary tables. Every ranking carries an explicit rank, with ties by id. Lists that a later step
gathers in one row are at most a few pools long, as they come from a top-k.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folding, has_work, index_tokens, jaccard, token_count, word_set

RRF = 60
PENALTY = 8
COLLAPSE = 0.8
#: Most hits of one request, as their collapsing folds over one row; more raise.
MOST_HITS = 10_000
K1, B = 1.2, 0.75


# -- the index --------------------------------------------------------------------------------------------------
def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, field, pos, token) of documents (id, title, text)."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in ("title", "text")])).alias("f")
    each = docs.select(F.col("id").alias("doc_id"), fields).select("doc_id", "f.field", F.posexplode(index_tokens(F.col("f.value"))).alias("pos", "token"))
    return each.select("doc_id", "field", "pos", "token")


def doc_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, dl): index tokens of title and text, also of documents without any."""
    return docs.select(F.col("id").alias("doc_id"), (token_count(F.col("title")) + token_count(F.col("text"))).alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row (n_docs, total_tokens)."""
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total_tokens"))


# -- filters and request parameters -----------------------------------------------------------------------------
def in_scope(docs: DataFrame, repo: str | None = None, source_type: str | None = None, since: datetime | Column | None = None) -> DataFrame:
    """``docs`` of a repository, of a type and not older than ``since``; a filter that is None or '' doesn't apply, a NULL time never passes ``since``."""
    if repo:
        docs = docs.where(F.col("repo") == repo)
    if source_type:
        docs = docs.where(F.col("source_type") == source_type)
    return docs.where(F.col("ts") >= F.lit(since)) if since is not None else docs


def parse_since(text: str | None, now: datetime | None = None) -> datetime | None:
    """The cut-off of a relative time such as ``7d``, ``24h`` or ``2w``; None, blank and anything else mean none."""
    m = re.fullmatch(r"(\d+)\s*([dhw])", (text or "").strip())
    if not m:
        return None
    return (now or datetime.now(UTC)) - {"d": timedelta(days=1), "h": timedelta(hours=1), "w": timedelta(weeks=1)}[m[2]] * int(m[1])


def resolve_repo(repo: str | None, here: str | None) -> str | None:
    """The repository a request is limited to: all of them for ``all``, else the named one, else the current one."""
    return None if repo and repo.lower() == "all" else repo or here


def query_phrases(query: str) -> list[list[str]]:
    """The index tokens of each piece of a query; a piece without any is dropped. The last token of each is a prefix."""
    table = str.maketrans(*folding())
    word = re.compile(r"[^\W_]+")
    pieces = [p for p in re.split(r"[^\w가-힣]+", query) if p]
    return [t for p in pieces if (t := word.findall(p.lower().translate(table)))]


# -- rankings ---------------------------------------------------------------------------------------------------
def _ranked(df: DataFrame, score: str, k: int, key: str = "doc_id") -> DataFrame:
    """The ``k`` best rows with rank from 1; only those are ever in one task."""
    best = df.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def lexical_scores(post: DataFrame, lengths: DataFrame, query: str) -> DataFrame:
    """(doc_id, score): BM25 of every document with a hit. Statistics are those of the whole index.

    Each query piece is a phrase within one field whose last token is a prefix; a piece that comes twice counts twice.
    The postings are read once, with the filters of all pieces pushed down to the scan.
    """
    phrases = query_phrases(query)
    empty = lengths.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    stats = corpus_stats(lengths).first()
    if not phrases or not stats["n_docs"]:
        return empty
    n, mean = stats["n_docs"], stats["total_tokens"] / stats["n_docs"]
    # one scan: a posting is tagged with every (phrase, place) that it can stand for
    places = [(number, k, t, k == len(tokens) - 1) for number, tokens in enumerate(phrases) for k, t in enumerate(tokens)]
    match = lambda t, last: F.col("token").startswith(t) if last else F.col("token") == t
    tags = F.array(*[F.when(match(t, last), F.struct(F.lit(number).alias("phrase"), F.lit(k).alias("k"))) for number, k, t, last in places])
    found = post.where(reduce(lambda x, y: x | y, [match(t, last) for _, _, t, last in places]))
    at = found.select("doc_id", "field", "pos", F.explode(F.array_compact(tags)).alias("x")).select("doc_id", "field", (F.col("pos") - F.col("x.k")).alias("start"), "x.phrase")
    if max(map(len, phrases)) > 1:  # a phrase has all its places
        length = F.element_at(F.array(*[F.lit(len(x)) for x in phrases]), F.col("phrase") + 1)
        at = at.groupBy("doc_id", "field", "start", "phrase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == length)
    hits = at.groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    idf = F.log((F.lit(n) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    scored = hits.join(F.broadcast(df), "phrase").join(lengths, "doc_id")  # a row per piece of the query
    part = F.when(idf <= 0, 1e-6).otherwise(idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
    return scored.groupBy("doc_id").agg(F.sum(part).alias("score"))


def lexical_topk(docs: DataFrame, query: str, k: int = 10, post: DataFrame | None = None, lengths: DataFrame | None = None, scope: Callable = in_scope, **filters) -> DataFrame:
    """(doc_id, score, rank) of the ``k`` best documents for a text query among those in scope."""
    scores = lexical_scores(postings(docs) if post is None else post, doc_lengths(docs) if lengths is None else lengths, query)
    kept = scope(docs, **filters).select(F.col("id").alias("doc_id"))
    return _ranked(scores.join(kept, "doc_id", "left_semi"), "score", k)


def vector_topk(vectors: DataFrame, query: list[float], k: int = 10, keep: DataFrame | None = None) -> DataFrame:
    """(doc_id, score, rank) of the ``k`` vectors (doc_id, vec) most similar to ``query``; ``keep`` (doc_id) limits them.

    No rows if any stored vector differs from the query in dimension, as then the model differs; NULL vectors don't count.
    """
    v = vectors.where("vec is not null")
    v = v if keep is None else v.join(keep, "doc_id", "left_semi")
    sizes = v.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if set(sizes) != {len(query)}:
        return v.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with("vec", q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    length = sum(float(x) ** 2 for x in query) ** 0.5 or 1.0
    raw = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return _ranked(v.select("doc_id", (dot / (raw * length + 1e-9)).alias("score")), "score", k)


def rrf_fuse(lists: list[DataFrame], k: int, c: int = RRF) -> DataFrame:
    """(doc_id, score, rank): lists (doc_id, rank) fused by reciprocal ranks; ties by first appearance, list before rank."""
    all_ = None
    for number, one in enumerate(lists):
        one = one.select("doc_id", "rank", F.lit(number).alias("list"))
        all_ = one if all_ is None else all_.unionAll(one)
    fused = all_.groupBy("doc_id").agg(F.sum(1.0 / (F.lit(c) + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    best = fused.withColumn("key", F.round("score", 12)).orderBy(F.desc("key"), "seen").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("key"), "seen"))).select("doc_id", "score", "rank")


def rerank(hits: DataFrame, penalty: int = PENALTY) -> DataFrame:
    """``hits`` (rank, works, ...) in a new rank order, where hits that are no work go ``penalty`` places down."""
    place = F.col("rank") + F.when(F.col("works"), 0).otherwise(penalty)
    return hits.withColumn("_p", place).withColumn("_r", F.row_number().over(Window.orderBy("_p", "rank"))).withColumn("rank", F.col("_r")).drop("_p", "_r")


def collapse(hits: DataFrame, threshold: float = COLLAPSE) -> DataFrame:
    """``hits`` (doc_id, rank, words, ...) without those whose words are like those of a kept one further up.

    Hits with no words (all that are no turns) are kept and drop nothing. The hits of one request are gathered in one
    row, which is read once; more than MOST_HITS are an error.
    """
    row = F.struct(F.col("rank").cast("int").alias("rank"), F.col("doc_id").cast("string").alias("doc_id"), "words", F.struct(*hits.columns).alias("row"))
    like = lambda kept, x: F.exists(kept, lambda y: (F.size(y["words"]) > 0) & (jaccard(x["words"], y["words"]) >= threshold))
    step = lambda kept, x: F.when((F.size(x["words"]) > 0) & like(kept, x), kept).otherwise(F.concat(kept, F.array(x)))
    one = hits.orderBy("rank").limit(MOST_HITS + 1).agg(F.array_sort(F.collect_list(row)).alias("all"))
    many = F.raise_error(F.lit(f"more than {MOST_HITS} hits to collapse")).cast("boolean")
    one = one.where(F.when(F.size("all") > MOST_HITS, many).otherwise(F.lit(True)))
    kept = one.select(F.explode(F.aggregate("all", F.filter("all", lambda x: F.lit(False)), step)).alias("x"))
    return kept.select("x.row.*")


def retrieve(
    docs: DataFrame, query: str, k: int = 5, *, vectors: DataFrame | None = None, query_vector: list[float] | None = None,
    post: DataFrame | None = None, lengths: DataFrame | None = None, penalty: int = PENALTY, **filters,
) -> DataFrame:
    """(doc_id, rank): hybrid retrieval (lexical alone without vectors), work before talk, repeated questions collapsed.

    ``docs``: (id, source_type, repo, title, text, ts, question, files, commits).
    """
    pool = max(3 * k, 15)
    side = max(2 * pool, 10)
    lexical = lexical_topk(docs, query, side if query_vector else pool, post, lengths, **filters)
    if query_vector and vectors is not None:
        near = vector_topk(vectors, query_vector, side, in_scope(docs, **filters).select(F.col("id").alias("doc_id")))
        lexical = rrf_fuse([lexical, near], pool)
    told = F.coalesce(F.nullif("question", F.lit("")), F.nullif("title", F.lit("")), F.col("text"))
    none = F.array().cast("array<string>")
    about = docs.select(
        F.col("id").alias("doc_id"),
        F.coalesce(has_work(F.col("source_type"), F.col("files"), F.col("commits")), F.lit(True)).alias("works"),
        F.when(F.col("source_type") == "agent_turn", word_set(told)).otherwise(none).alias("words"),
    )
    hits = rerank(about.join(F.broadcast(lexical), "doc_id"), penalty)  # at most a pool of rows
    kept = collapse(hits)
    return kept.orderBy("rank").limit(k).select("doc_id", F.row_number().over(Window.orderBy("rank")).alias("rank"))


def recent(docs: DataFrame, limit: int = 50, **filters) -> DataFrame:
    """The newest ``limit`` documents in scope, ordered from the oldest to the newest; NULL times come last in age."""
    newest = in_scope(docs, **filters).orderBy(F.desc_nulls_last("ts"), "id").limit(limit)
    return newest.orderBy(F.asc_nulls_first("ts"), F.desc("id"))


def stats(docs: DataFrame) -> DataFrame:
    """(dimension, value, n): documents in all, by type, by repository and, of turns with an agent, by agent."""
    g = docs.select("source_type", "repo", F.when(F.col("source_type") == "agent_turn", F.col("agent")).alias("agent"))
    sets = g.groupingSets([[], ["source_type"], ["repo"], ["agent"]], "source_type", "repo", "agent").agg(
        F.grouping_id().cast("int").alias("g"), F.count(F.lit(1)).alias("n")
    )
    dim = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "source_type").when(F.col("g") == 5, "repo").otherwise("agent")
    value = F.when(F.col("g") == 7, F.lit("")).otherwise(F.coalesce("source_type", "repo", "agent", F.lit("")))
    return sets.where("g <> 6 or agent is not null").select(dim.alias("dimension"), value.alias("value"), "n")


