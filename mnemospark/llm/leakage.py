"""Problem 8: passages of held-out evaluation items inside corpus documents, by MinHash containment.

A short item lies inside a long document if some of its passages do. The size partition of the search is the
passage: items and documents, however long, are cut into all their runs of PASSAGE words, so that query and domain
have the same size and containment equals similarity; a passage's MinHash over its SHINGLE-word shingles then
collides for certain with that of an equal passage, and a document keeps only its distinct minima (about two in
nine shingles). Documents that share a minimum with an item are verified by exact containment of word passages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table

PASSAGE = 12
SHINGLE = 5
#: Item minima up to which they are sent to all tasks to thin out the documents' minima before the join (16 MB).
SENT_MINIMA = 2_000_000
#: Candidate pairs of ids up to which they are sent to all tasks (16 bytes each) rather than joined by a shuffle.
SENT_PAIRS = 400_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The runs of letters and digits of ``text`` in lower case."""
    return _WORD.findall(text.lower()) if text else []


class _Ids(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
        return h


def passage_minima(texts: list[str | None], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, minimum) of every distinct passage minimum of every text, vectorised over the batch."""
    words = [words_of(t) for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    h = np.fromiter((ids[x] for w in words for x in w), dtype=np.uint64, count=int(n.sum()))
    owner = np.repeat(np.arange(len(texts)), n)
    if len(h) < PASSAGE:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    s = np.zeros(len(h) - SHINGLE + 1, dtype=np.uint64)
    for k in range(SHINGLE):
        s = (s ^ h[k : k + len(s)]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    span = PASSAGE - SHINGLE + 1
    m, width = s, 1
    while width < span:
        step = min(width, span - width)
        m = np.minimum(m[:-step], m[step:])
        width += step
    whole = owner[: len(m)] == owner[PASSAGE - 1 : PASSAGE - 1 + len(m)]
    pairs = np.unique(np.stack([owner[: len(m)][whole], m[whole].view(np.int64)]), axis=1)
    return pairs[0], pairs[1]


def passages(text: str | None) -> set[str]:
    """All runs of PASSAGE consecutive words of ``text``."""
    w = words_of(text)
    return {" ".join(w[i : i + PASSAGE]) for i in range(len(w) - PASSAGE + 1)}


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every document (doc_id, text) that holds at least PASSAGE consecutive words of an item (item_id, text).

    Words are runs of letters or digits, case ignored. NULL and short texts match nothing; rows that repeat count
    once, and a repeated id with another text has both; other columns are dropped. Item minima are sent to all tasks only
    up to SENT_MINIMA; beyond that the documents' minima are joined without being thinned out.
    """
    spark = documents.sparkSession

    def minima(key: str, keep: np.ndarray | None = None):
        known = spark.sparkContext.broadcast(keep) if keep is not None else None

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids = _Ids()
            for b in batches:
                for at in range(0, len(b), 2_000):
                    part = b.iloc[at : at + 2_000]
                    owner, m = passage_minima(part["text"].tolist(), ids)
                    if known is not None and len(m):
                        v = known.value
                        hit = v[np.minimum(np.searchsorted(v, m), len(v) - 1)] == m if len(v) else np.zeros(len(m), bool)
                        owner, m = owner[hit], m[hit]
                    yield pd.DataFrame({key: part[key].to_numpy()[owner], "minimum": m})

        return run

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    its = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).where("item_id is not null and item_text is not null")
    item_minima = cut(its.withColumnRenamed("item_text", "text").mapInPandas(minima("item_id"), "item_id long, minimum long").distinct())
    few = item_minima.select("minimum").distinct().limit(SENT_MINIMA + 1).toPandas()["minimum"].to_numpy()
    keep = np.sort(few) if len(few) <= SENT_MINIMA else None
    shared = docs.mapInPandas(minima("doc_id", keep), "doc_id long, minimum long").distinct().join(item_minima, "minimum")
    pairs = cut(shared.select("doc_id", "item_id").distinct())  # ids first: a text is read once more, however many minima it shares
    if pairs.count() <= SENT_PAIRS:
        pairs = F.broadcast(pairs)
    candidates = docs.join(pairs, "doc_id").join(its, "item_id")

    @F.pandas_udf("boolean")
    def holds(text: pd.Series, item: pd.Series) -> pd.Series:
        known: dict[str, set[str]] = {}
        out = []
        for t, i in zip(text, item, strict=True):
            p = known.get(i)
            if p is None:
                p = known[i] = passages(i)
            out.append(not p.isdisjoint(passages(t)))
        return pd.Series(out, dtype=bool)

    return candidates.where(holds("text", "item_text")).select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every leaked item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


QUERIES = {"p8_found": p8_found}
SQL = {
    "p8_found": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
     v AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM eval_items WHERE text IS NOT NULL),
     d AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+11], ' ') AS p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM w)),
     e AS (SELECT DISTINCT item_id, array_to_string(ws[i:i+11], ' ') AS p FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM v))
SELECT DISTINCT d.doc_id, e.item_id FROM d JOIN e USING (p)
"""
}
