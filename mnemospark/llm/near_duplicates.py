"""Problem 3: groups of records whose word sets are alike, by a token-group matrix.

Equal word sets are one record with copies. Similar sets are brought together by sorting on MinHash values and put
into groups of at most GROUP members that are alike, each with the union of its members' tokens: a row of the matrix.
Its columns are the members' rarest tokens, as many as any partner must share one of. A token in more than RARE sets
is no column by itself, only together with a second one, so that no column grows with the collection: sets whose rare
tokens all differ must share several of their next tokens, two of them of the same class. A set asks the matrix for the
groups of its columns. A bit map of the union bounds the overlap first; groups that pass are opened if the set's
overlap with the union itself reaches the least a partner needs, and then members are compared. Tokens are 64-bit
hashes of words. Links become groups by alternating large-star and small-star joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut, table

THRESHOLD = 0.8
GROUP = 32
#: Sets up to which a token is rare; commoner ones are columns in pairs only.
RARE = 16
#: Counters that order tokens by the sets they are in. Tokens that share one count as commoner, which costs columns, never links.
BUCKETS, CHUNK = 1 << 22, 1 << 16
#: Longs of a union's bit map, and counters (bits) that tell which columns the matrix has.
MAP, KNOWN = 8, 1 << 25
#: Links asked for up to which they are sent to all tasks (16 bytes each) rather than joined by shuffles.
SENT_PAIRS = 400_000
#: Smaller sets' tokens per class of common tokens.
CLASS_SIZE = 32
_WORD = re.compile(r"\w+")


class _Ids(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
        return h


def least_overlap(n: int, m: int = 0) -> int:
    """Fewest common tokens that sets of ``n`` and ``m`` (or any number of) tokens with similarity THRESHOLD have."""
    if not m:
        return -(-4 * n // 5)
    return -(-4 * (n + m) // 9)


def alike(t: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of the sets that lie one after the other in ``flat`` reach the threshold with the sorted set ``t``, exactly."""
    hits = t[np.minimum(np.searchsorted(t, flat), len(t) - 1)] == flat
    common = np.add.reduceat(hits, np.cumsum(sizes) - sizes, dtype=np.int64)
    return 9 * common >= 4 * (len(t) + sizes)


def _mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    x = (a ^ (np.uint64(b) if isinstance(b, int) else b)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _classes(sizes: np.ndarray) -> np.ndarray:
    """Classes of common tokens for pairs whose smaller sets have ``sizes`` tokens: powers of two that grow with them."""
    return np.left_shift(1, np.floor(np.log2(np.maximum(sizes // CLASS_SIZE, 1))).astype(np.int64))


def columns(flat: np.ndarray, counts: np.ndarray, sizes: np.ndarray, smaller: bool) -> tuple[np.ndarray, np.ndarray]:
    """(set, column) of the matrix columns of sets that lie one after the other in ``flat``, with the frequency codes
    ``counts``, as the ``smaller`` (or equal) set of a pair or the larger.

    The smaller set shares at least 8/9 of its tokens, the larger 4/5, hence a token of the prefix that lacks one less.
    If that is rare it is a column. Otherwise all common tokens are common words, and in prefixes longer by c the sets
    share at least c + 1 of them, two of which fall in the same of c classes.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((flat, counts, owner))
    t, codes = flat[order], counts[order]
    place = np.arange(len(t)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    prefix = sizes - (-(-8 * sizes // 9) if smaller else -(-4 * sizes // 5)) + 1
    rare = (place < prefix[owner]) & (codes > 1) & (codes <= RARE)  # a token of one set only links nothing
    sets, found = [owner[rare]], [_mixed(t[rare], 1)]
    own, least = _classes(sizes), _classes(-(-4 * sizes // 5))
    for classes, of in ((own, None),) if smaller else ((own, None), (least, least != own)):
        c = classes[owner]
        common = (codes > RARE) & (place < prefix[owner] + c)
        if of is not None:
            common &= of[owner]
        o, x, c = owner[common], t[common], c[common]
        kind = ((x >> np.uint64(20)) % c.astype(np.uint64)).astype(np.int64)
        by = np.lexsort((kind, o))
        o, x, c, kind = o[by], x[by], c[by], kind[by]
        starts = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (kind[1:] != kind[:-1])])) if len(o) else np.zeros(0, np.int64)
        behind = np.arange(len(o)) - np.repeat(starts, np.diff(np.append(starts, len(o))))  # each is paired with those before it
        b = np.repeat(np.arange(len(o)), behind)
        a = np.arange(len(b)) - np.repeat(np.cumsum(behind) - behind, behind) + b - behind[b]
        sets.append(o[b])
        found.append(_mixed(_mixed(x[a], c[b].astype(np.uint64) + np.uint64(1)), x[b]))
    return np.concatenate(sets), np.concatenate(found)


def _token_sets(batches: Iterator[pd.DataFrame], with_tokens: bool) -> Iterator[pd.DataFrame]:
    """Nodes with the key of their word set (its 128-bit hash and the source) and, if wanted, its tokens and MinHash values."""
    ids = _Ids()
    for b in batches:
        rows = []
        for node, t in zip(b["node"], b["text"], strict=True):
            words = set(_WORD.findall(t.lower())) if t else ()
            if not words:
                continue
            key = xxhash.xxh3_128_digest("\n".join(sorted(words)).encode("utf-8", "replace")) + bytes([node & 1])
            if not with_tokens:
                rows.append((node, key))
                continue
            a = np.unique(np.fromiter((ids[w] for w in words), dtype=np.uint64, count=len(words)))
            mins = [int((_mixed(a, m) >> np.uint64(32)).min()) for m in (1, 2, 3)]
            rows.append((node, key, mins[0] * 2 + (node & 1), *mins[1:], a.view(np.int64)))
        yield pd.DataFrame(rows, columns=["node", "key"] + (["m1", "m2", "m3", "tokens"] if with_tokens else []))


def _tokens(column: np.ndarray) -> np.ndarray:
    return np.asarray(column, dtype=np.int64).view(np.uint64)


def _cut_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (m1, ...) as groups of neighbours that are alike. A set takes the label of the first of the last GROUP
    or more sets that it is like, so that long runs of near-copies carry one label; memory holds two times GROUP sets."""
    run = None
    before: list[tuple[int, int, np.ndarray]] = []
    now: list[tuple[int, int, np.ndarray]] = []

    def rows() -> Iterator[tuple]:
        classes: dict[int, list] = {}
        for x in now:
            classes.setdefault(x[1], []).append(x)
        for label, m in classes.items():
            yield m[0][0], label, [x[0] for x in m], [len(x[2]) for x in m], np.concatenate([x[2] for x in m]).view(np.int64)

    names = ["gid", "label", "sids", "sizes", "tokens"]
    for b in batches:
        out = []
        for m1, sid, tokens in zip(b["m1"], b["sid"], b["tokens"], strict=True):
            if run != m1 or len(now) >= GROUP:
                out += rows()
                before = now if run == m1 else []
                run, now = m1, []
            t, label = _tokens(tokens), sid
            near = [x for x in now + before if 4 * len(t) <= 5 * len(x[2]) <= 6.25 * len(t)]
            if near:
                like = np.flatnonzero(alike(t, np.concatenate([x[2] for x in near]), np.array([len(x[2]) for x in near])))
                label = near[like[0]][1] if len(like) else sid
            now.append((sid, label, t))
        if out:
            yield pd.DataFrame(out, columns=names)
    if now:
        yield pd.DataFrame(list(rows()), columns=names)


def _packed(sums: DataFrame, size: int, fill: int) -> np.ndarray:
    """One byte for each of ``size`` counters from ``sums`` (slot, n) with n below 256; the driver gets CHUNK of them at a time."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.full(CHUNK, fill, dtype=np.uint8)
        out[pdf["slot"].to_numpy() % CHUNK] = pdf["n"].to_numpy()
        return pd.DataFrame({"chunk": [int(pdf["slot"].iloc[0]) // CHUNK], "bytes": [out.tobytes()]})

    total = np.full(size, fill, dtype=np.uint8)
    for r in sums.groupBy(F.floor(F.col("slot") / CHUNK)).applyInPandas(pack, "chunk int, bytes binary").toLocalIterator():
        total[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(r["bytes"]), np.uint8)
    return total


def _rare_counts(groups: DataFrame) -> np.ndarray:
    """For each of BUCKETS counters a code of the number n of sets with one of its tokens: n up to RARE, beyond it RARE
    and eight times the binary logarithm of n / RARE, which a byte holds up to n = 10^10. Tasks send their non-zero
    counters, which are summed in the JVM."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int32)
        for b in batches:
            for at in range(0, len(b), 2_000):
                flat = np.concatenate([_tokens(t) for t in b["tokens"].iloc[at : at + 2_000]])
                slot, n = np.unique(flat & np.uint64(BUCKETS - 1), return_counts=True)
                total[slot.astype(np.int64)] += n.astype(np.int32)
        slot = np.flatnonzero(total)
        for at in range(0, len(slot), 100_000):
            yield pd.DataFrame({"slot": slot[at : at + 100_000].astype(np.int32), "n": total[slot[at : at + 100_000]].astype(np.int64)})

    sums = groups.select("tokens").mapInPandas(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    code = F.when(F.col("n") <= RARE, F.col("n")).otherwise(F.least(F.lit(255), RARE + F.ceil(8 * F.log2(F.col("n") / RARE))))
    return _packed(sums.where("n > 1").select("slot", code.cast("int").alias("n")), BUCKETS, 1)


def _bit_maps(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(sets x MAP) longs: the bit maps of sets that lie one after the other."""
    bits = np.zeros((len(sizes), MAP * 64), dtype=np.uint8)
    bits[np.repeat(np.arange(len(sizes)), sizes), ((flat >> np.uint64(40)) % np.uint64(MAP * 64)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.int64)


def _matrix(groups: DataFrame, asks: bool, counts, known=None) -> DataFrame:
    """The columns of every group (key, gid, label, low, high and the bit map of its union), or, if it ``asks``, those of
    every set that the matrix has (key, sid, own, n and its bit map)."""
    names = ["key", "sid", "own", "n"] if asks else ["key", "gid", "label", "low", "high"]
    maps = [("q" if asks else "u") + str(k) for k in range(MAP)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, bits = counts.value, None if known is None else known.value
        for whole in batches:
            for at in range(0, len(whole), 1_000):
                b = whole.iloc[at : at + 1_000]
                flat = np.concatenate([_tokens(t) for t in b["tokens"]])
                members = b["sizes"].map(len).to_numpy()
                sizes, sids = np.concatenate(b["sizes"].to_list()).astype(np.int64), np.concatenate(b["sids"].to_list())
                group = np.repeat(np.arange(len(b)), members)
                owner, key = columns(flat, df[(flat & np.uint64(BUCKETS - 1)).astype(np.int64)], sizes, not asks)
                key = _mixed(key, (sids[owner] & 1).astype(np.uint64))
                if asks:
                    slot = (key >> np.uint64(17)) % np.uint64(KNOWN)
                    has = bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1
                    owner, key = owner[has], key[has]
                    out = [key.view(np.int64), sids[owner], b["label"].to_numpy()[group[owner]], sizes[owner]]
                    of = _bit_maps(flat, sizes)[owner]
                else:
                    owner, key = group[owner], key.view(np.int64)
                    by = np.lexsort((key, owner))
                    owner, key = owner[by], key[by]
                    once = np.concatenate([[True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.zeros(0, bool)
                    owner, key = owner[once], key[once]
                    first = np.cumsum(members) - members
                    out = [key, b["gid"].to_numpy()[owner], b["label"].to_numpy()[owner], np.minimum.reduceat(sizes, first)[owner], np.maximum.reduceat(sizes, first)[owner]]
                    of = _bit_maps(flat, np.add.reduceat(sizes, first))[owner]
                yield pd.DataFrame(dict(zip(names, out, strict=True)) | {n: of[:, k] for k, n in enumerate(maps)})

    types = {"n": "int", "low": "int", "high": "int"}
    schema = ", ".join(f"{n} {types.get(n, 'long')}" for n in names + maps)
    return groups.select("gid", "label", "sids", "sizes", "tokens").mapInPandas(run, schema)


def candidates(groups: DataFrame) -> DataFrame:
    """(key, sid, gid) of sets and groups of another label that share a column of the matrix, before any bound."""
    return _shared(groups)[0].select("key", "sid", "gid")


def _shared(groups: DataFrame) -> tuple[DataFrame, Column]:
    spark = groups.sparkSession
    counts = spark.sparkContext.broadcast(_rare_counts(groups))
    held = cut(_matrix(groups, False, counts), sized=False)
    slot = F.pmod(F.shiftrightunsigned("key", 17), F.lit(KNOWN))
    byte = held.select(F.floor(slot / 8).cast("int").alias("slot"), F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (slot % 8 + 1).cast("int")).alias("bit"))
    known = spark.sparkContext.broadcast(_packed(byte.groupBy("slot").agg(F.bit_or("bit").alias("n")), KNOWN // 8, 0))
    asked = _matrix(groups, True, counts, known)
    lacking = sum((F.bit_count(F.col(f"q{k}").bitwiseAND(F.bitwise_not(F.col(f"u{k}")))) for k in range(MAP)), F.lit(0))
    fits = (F.col("low") <= F.col("n")) & (F.col("high") * 5 >= F.col("n") * 4) & (lacking * 5 <= F.col("n"))
    return asked.join(held, "key").where(F.col("own") != F.col("label")), fits


def _links(groups: DataFrame) -> DataFrame:
    """(a, b) of links between sets of different labels, enough to connect all that are connected."""
    shared, fits = _shared(groups)
    pairs = cut(shared.where(fits).select("sid", "gid").distinct(), sized=False)
    if pairs.count() <= SENT_PAIRS:
        pairs = F.broadcast(pairs)
    members = groups.select(F.posexplode("sids").alias("k", "sid"), "sizes", "tokens")
    start = F.aggregate(F.slice("sizes", F.lit(1), F.col("k")), F.lit(0), lambda a, x: a + x)
    asked = cut(members.join(pairs, "sid").select("sid", "gid", F.slice("tokens", start + 1, F.get("sizes", F.col("k"))).alias("query")), sized=False)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for sid, query, sids, sizes, flat in zip(*(b[c] for c in b.columns), strict=True):
                query, flat = _tokens(query), _tokens(flat)
                if np.isin(query, flat).sum() < least_overlap(len(query)):
                    continue  # the union bounds the overlap with every member
                like = np.flatnonzero(alike(query, flat, np.asarray(sizes, dtype=np.int64)))
                if len(like):
                    rows.append((sid, sids[like[0]]))
            yield pd.DataFrame(rows, columns=["a", "b"])

    return groups.join(asked, "gid").select("sid", "query", "sids", "sizes", "tokens").mapInPandas(verify, "a long, b long")


def _grouped(r: DataFrame) -> DataFrame:
    """The groups of the distinct word sets of ``r`` (node, text), written once."""
    sets = r.mapInPandas(lambda b: _token_sets(b, True), "node long, key binary, m1 long, m2 long, m3 long, tokens array<long>")
    one = sets.groupBy("key").agg(F.min("node").alias("sid"), F.first(F.struct("m1", "m2", "m3", "tokens")).alias("x")).select("sid", "x.*")
    order = ["m1", "m2", "m3", "sid"]
    rows = one.repartitionByRange(*order).sortWithinPartitions(*order).select("m1", "sid", "tokens")
    return cut(rows.mapInPandas(_cut_groups, "gid long, label long, sids array<long>, sizes array<int>, tokens array<long>"), sized=False)


def near_duplicate_groups(records: DataFrame) -> DataFrame:
    """(src, row_id, group_id): groups of records of one ``src`` connected by word sets of similarity THRESHOLD or more.

    ``records``: (src, row_id, text) with src ``doc`` or ``turn``; words are the lower-case ``\\w+``. A group is named after
    its smallest row_id. Groups of one, NULL texts, texts without words and NULL ids give no row; a row_id that comes
    again with the same text counts once (with another text, both its sets link it); other columns are dropped.
    """
    node = F.col("row_id").cast("long") * 2 + F.when(F.col("src") == "turn", 1).otherwise(0)
    r = records.where("src in ('doc', 'turn') and row_id is not null and text is not null").select(node.alias("node"), "text")
    groups = _grouped(r)
    near = groups.select(F.explode("sids").alias("a"), F.col("label").alias("b"))
    links = _links(groups).unionAll(near.where("a <> b"))

    keys = cut(r.mapInPandas(lambda b: _token_sets(b, False), "node long, key binary").distinct(), sized=False)
    copies = keys.groupBy("key").agg(F.min("node").alias("sid"), (F.min("node") < F.max("node")).alias("copied"))
    several = keys.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    bridges = keys.join(several, "node").join(copies, "key").select(F.col("node").alias("a"), F.col("sid").alias("b"))
    found = connected_components(links.unionAll(bridges))
    reps = copies.join(found, copies["sid"] == found["node"], "left").drop("node")
    reps = reps.select("key", F.coalesce("component", F.when(F.col("copied"), F.col("sid"))).alias("g")).where("g is not null")
    row = lambda c: F.floor(F.col(c) / 2).cast("long")
    named = keys.join(reps, "key").select(F.when(F.col("node") % 2 == 1, F.lit("turn")).otherwise(F.lit("doc")).alias("src"), row("node").alias("row_id"), row("g").alias("group_id"))
    return named.distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_id, group_id) of all documents and of the questions of all turns."""
    docs = table(spark, sf_dir, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("row_id"), "text")
    turns = table(spark, sf_dir, "turns").select(F.lit("turn").alias("src"), F.col("turn_id").alias("row_id"), F.col("question").alias("text"))
    return near_duplicate_groups(docs.unionAll(turns))


QUERIES = {"p3_found": p3_found}
_FOLD = "regexp_extract_all(replace(lower(t), '\u0130', 'i\u0307'), '[\\p{L}\\p{N}_]+')"
SQL = {
    "p3_found": f"""
WITH RECURSIVE r AS (SELECT 'doc' AS src, doc_id AS id, text AS t FROM documents WHERE text IS NOT NULL UNION SELECT 'turn', turn_id, question FROM turns WHERE question IS NOT NULL),
     s AS (SELECT src, id, list_sort(list_distinct({_FOLD})) AS ws FROM r),
     u AS (SELECT src, min(id) AS sid, ws, len(ws) AS n FROM s WHERE len(ws) > 0 GROUP BY src, ws),
     w AS (SELECT src, sid, n, unnest(ws) AS w FROM u),
     c AS (SELECT a.src, a.sid AS a, b.sid AS b FROM w a JOIN w b ON a.src = b.src AND a.w = b.w AND a.sid < b.sid AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
           GROUP BY a.src, a.sid, b.sid, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
     k AS (SELECT u.src, u.sid AS a, s.id AS b FROM u JOIN s ON u.src = s.src AND u.ws = s.ws AND u.sid <> s.id),
     e AS (SELECT * FROM c UNION SELECT * FROM k),
     ends AS (SELECT src, a, b FROM e UNION SELECT src, b, a FROM e),
     reach AS (SELECT DISTINCT src, a AS id, a AS g FROM ends UNION SELECT reach.src, ends.b, reach.g FROM reach JOIN ends ON ends.src = reach.src AND ends.a = reach.id)
SELECT src, id AS row_id, min(g) AS group_id FROM reach GROUP BY src, id
"""
}
