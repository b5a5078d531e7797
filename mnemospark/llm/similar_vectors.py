"""Problem 2: the most similar vectors of every vector, by collision-counting hashing.

Vectors are partitioned into cells around centres fitted on a bounded sample; every vector is in the cell of its
nearest centre. In a cell single projections are kept as sorted arrays. A query widens the windows centred on its own
projections level by level (virtual rehashing: no table is built again), counts in how many windows each vector lies,
and verifies those that exceed the collision threshold. It ends once the k-th best verified vector is nearer than the
level's radius, where every nearer vector would have collided with high probability; the last level holds the whole
cell. So each query first learns from its own cell how far its k-th neighbour is at most. That radius is the window
on the projection that separates its cell from any other: only cells that the window reaches are asked, at that
radius. Work therefore grows with the vectors in reached cells, not with the square of the collection. Equal vectors
are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, table

NEIGHBOURS = 10
#: Single-projection hashes, half width of a window at radius 1 and least share of the windows a candidate is in.
PROJECTIONS, WIDTH, COLLIDING = 16, 1.3, 0.5
#: Radii grow by this factor from level to level.
GROWTH = 2.0
#: Half width, at radius 1, of the window on the projection between two cells' centres.
REACH = 0.5
#: Vectors a cell has on average, and those of a cell that one task holds or asks at once.
CELL, BLOCK = 1_024, 4_096
#: Pairs of queries and vectors whose counters and cosines are in memory at once.
PAIRS_AT_ONCE = 400_000
#: Distances between vectors and centres that are in memory at once.
AT_ONCE = 1 << 21
#: Share of candidates among those pairs from which all cosines are made by one matrix product, of which candidates' count.
DENSE = 0.05
#: Components of all vectors that cells are fitted on (64 MB), and sampled vectors that a cell takes at least.
SAMPLE_VALUES, PER_CELL = 1 << 24, 16
#: Dimensions that cells are fitted for; a collection has one, or a few by model.
FITTED = 16
SEED = 20_240_601


def search_block(data: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, radii: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, cosine) of each query's ``k`` (or all, if fewer) best vectors of the block; with ``radii`` of its
    candidates at that radius only. Rows have length 1."""
    n, dim = data.shape
    rng = np.random.default_rng(SEED)
    axes = rng.standard_normal((dim, PROJECTIONS))
    projected, centres = data @ axes, queries @ axes
    order = np.argsort(projected, axis=0, kind="stable")
    lines = np.take_along_axis(projected, order, axis=0)
    kind, whole = (np.int16, np.uint16) if n < 1 << 15 else (np.int32, np.uint32)
    place = np.empty((PROJECTIONS, n), dtype=kind)
    for i in range(PROJECTIONS):
        place[i, order[:, i]] = np.arange(n)
    need = int(np.ceil(COLLIDING * PROJECTIONS))
    if radii is None:
        probe = rng.choice(n, size=min(n, 64), replace=False)
        near = np.sort(np.sqrt(np.maximum(0, 2 - 2 * data[probe] @ data.T)), axis=1)[:, min(k, n - 1)]
        first = max(0.02, float(np.quantile(near, 0.6)))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(16, PAIRS_AT_ONCE // n)
    for start in range(0, len(queries), step):
        pending = np.arange(start, min(start + step, len(queries)))
        r = np.full(len(pending), first) if radii is None else radii[pending]
        while len(pending):
            last = (r >= 2) | (n <= k)
            counts = np.zeros((len(pending), n), dtype=np.uint8)
            for i in range(PROJECTIONS):  # the window as places of the sorted array
                low = np.searchsorted(lines[:, i], centres[pending, i] - WIDTH * r).astype(kind)
                high = np.searchsorted(lines[:, i], centres[pending, i] + WIDTH * r, side="right").astype(kind)
                counts += (place[i][None, :] - low[:, None]).view(whole) < (high - low).view(whole)[:, None]
            candidate = (counts >= need) | last[:, None]
            if np.count_nonzero(candidate) > DENSE * candidate.size:  # one product costs less than many gathers
                table = np.where(candidate, queries[pending] @ data.T, -4.0)
            else:
                q, at = np.nonzero(candidate)
                table = np.full(candidate.shape, -4.0)
                table[q, at] = np.einsum("ij,ij->i", queries[pending[q]], data[at])
            bound = np.partition(table, max(0, n - k), axis=1)[:, max(0, n - k)]
            ended = last | (radii is not None) | (np.sqrt(np.maximum(0, 2 - 2 * bound)) <= r)
            q, at = np.nonzero((table >= np.maximum(bound, -2)[:, None]) & ended[:, None])
            c = table[q, at]
            best = np.lexsort((ids[at], -c, q))
            q, at, c = q[best], at[best], c[best]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            found.append((pending[q[rank < k]], ids[at[rank < k]], c[rank < k]))
            pending, r = pending[~ended], r[~ended] * GROWTH
    return tuple(np.concatenate([f[j] for f in found]) for j in range(3))


def fit_cells(sample: np.ndarray, cells: int) -> np.ndarray:
    """``cells`` centres of the rows of ``sample`` by a few rounds of k-means; a part of the rows at a time."""
    centres = sample[np.random.default_rng(SEED).choice(len(sample), cells, replace=False)].copy()
    for _ in range(8 if cells > 1 else 1):
        home = np.concatenate([nearest(sample[at], centres)[0] for at in parts_of(len(sample), cells)])
        order = np.argsort(home, kind="stable")
        sums, size = np.zeros((cells, sample.shape[1])), np.bincount(home, minlength=cells)
        for at in parts_of(len(order), sample.shape[1]):
            own, first = np.unique(home[order[at]], return_index=True)
            sums[own] += np.add.reduceat(sample[order[at]], first, axis=0)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def parts_of(rows: int, width: int) -> list[slice]:
    """``rows`` rows in parts of which a table of ``width`` columns has at most AT_ONCE numbers."""
    step = max(1, AT_ONCE // width)
    return [slice(at, min(at + step, rows)) for at in range(0, rows, step)] or [slice(0, 0)]


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every row, and the squared distances to all but for the rows' own lengths."""
    apart = x @ (-2 * centres.T)
    apart += (centres**2).sum(axis=1)
    return apart.argmin(axis=1), apart


def _sampled(unique: DataFrame, dim: int, n: int, most: int) -> np.ndarray:
    """About ``most`` (or all, if fewer) of the ``n`` vectors of one dimension, at length 1, in the order of their hashed
    ids. Tasks pick them and send them as bytes, about 4 MB at a time."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"n": [len(b)], "h": [b["h"].to_numpy(dtype=np.int64).tobytes()], "x": [_unit(b["vec"]).tobytes()]})

    h = unique.where(F.col("dim") == dim).select(F.xxhash64("uid").alias("h"), "vec")
    drawn = h if n <= most else h.where(F.pmod(F.xxhash64(F.lit(SEED), "h"), F.lit(1 << 40)) < int(most / n * (1 << 40)))
    packed = drawn.mapInPandas(pack, "n int, h binary, x binary").repartition(max(1, min(n, most) * dim >> 20))
    hashes, rows = [], []
    for r in packed.toLocalIterator():
        hashes.append(np.frombuffer(bytes(r["h"]), np.int64))
        rows.append(np.frombuffer(bytes(r["x"]), np.float32).reshape(r["n"], dim))
    order = np.argsort(np.concatenate(hashes), kind="stable")
    return np.concatenate(rows)[order]


def nearest_vectors(vectors: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(vec_id, nbr_id, cosine): the ``k`` most similar other vectors of each vector, ties by smaller id.

    ``vectors``: (vec_id, vec). NULL ids and vectors, vectors with a NULL or NaN component, of length 0 and rows that
    repeat an id count not at all or once; vectors of different dimension are never compared; with fewer than ``k``
    others all are given. Other columns are dropped. Cells are fitted for the FITTED commonest dimensions; any other is one cell.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast("array<float>").alias("vec")).dropna()
    v = v.where(F.exists("vec", lambda x: x != 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x)))
    v = cut(v.groupBy("vec_id").agg(F.min("vec").alias("vec")), sized=False)
    ranked = v.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    unique = ranked.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    unique = cut(unique.select(F.get("ids", F.lit(0)).alias("uid"), F.size("vec").alias("dim"), "vec", "ids"), sized=False)
    spark = vectors.sparkSession
    sizes = {r["dim"]: r["n"] for r in unique.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(FITTED).collect()}
    fitted: dict[int, np.ndarray] = {}
    first = 0
    for dim, n in sizes.items():
        x = _sampled(unique, dim, n, max(PER_CELL, SAMPLE_VALUES // len(sizes) // dim))
        fitted[dim] = fit_cells(x, max(1, min(n // CELL, len(x) // PER_CELL)))
    starts = dict(zip(fitted, np.cumsum([0, *(len(c) for c in fitted.values())]).tolist(), strict=False))
    shared = spark.sparkContext.broadcast((fitted, starts))

    def by_dim(b: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray | None, int]]:
        centres, start = shared.value
        for dim, part in b.groupby(b["vec"].map(len)):
            yield part, _unit(part["vec"]), centres.get(dim), start.get(dim, -dim)  # a dimension without centres is one cell

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, x, centres, start in by_dim(b):
                cell = np.zeros(len(x), dtype=np.int64) if centres is None else np.concatenate([nearest(x[at], centres)[0] for at in parts_of(len(x), len(centres))])
                yield pd.DataFrame({"uid": part["uid"], "cell": start + cell, "vec": part["vec"]})

    celled = cut(unique.select("uid", "vec").mapInPandas(assign, "uid long, cell long, vec array<float>"), sized=False)
    parts = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    data = celled.join(parts, "cell")

    def asked(queries: DataFrame) -> DataFrame:
        """(uid, other, cosine) for queries (uid, cell, vec, radius); a NULL radius searches level by level."""
        q = queries.join(parts, "cell")
        load = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("askers"))
        every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        some = lambda seed, of: F.pmod(F.xxhash64(F.lit(seed), "uid"), F.col(of)).cast("int")
        asking = q.join(load, "cell").select("cell", some(1, "askers").alias("q"), every("parts").alias("d"), "uid", "vec", "radius", F.lit(True).alias("query"))
        held = data.join(load, "cell").select("cell", every("askers").alias("q"), some(2, "parts").alias("d"), "uid", "vec", F.lit(None).cast("double").alias("radius"), F.lit(False).alias("query"))

        def search(pdf: pd.DataFrame) -> pd.DataFrame:
            x, is_query, ids = _unit(pdf["vec"]).astype(np.float64), pdf["query"].to_numpy(), pdf["uid"].to_numpy()
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            if is_query.all() or not is_query.any():
                return pd.DataFrame({"uid": [], "other": [], "cosine": []}).astype({"uid": "int64", "other": "int64", "cosine": "float64"})
            radii = pdf["radius"].to_numpy(dtype=np.float64)[is_query]
            q, other, cosine = search_block(x[~is_query], ids[~is_query], x[is_query], k + 1, None if np.isnan(radii).any() else radii)
            return pd.DataFrame({"uid": ids[is_query][q], "other": other, "cosine": cosine})

        return asking.unionAll(held).groupBy("cell", "q", "d").applyInPandas(search, "uid long, other long, cosine double")

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for whole, vectors, centres, start in by_dim(b):
                if centres is None or len(centres) < 2:
                    continue
                for piece in parts_of(len(whole), len(centres)):
                    part, x = whole.iloc[piece], vectors[piece]
                    apart, home = nearest(x, centres)[1], part["cell"].to_numpy() - start
                    own = np.take_along_axis(apart, home[:, None], axis=1)
                    between = np.sqrt(np.maximum(1e-12, ((centres[home] ** 2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * centres[home] @ centres.T)))
                    open_ = (apart - own) / (2 * between) <= REACH * part["radius"].to_numpy()[:, None]
                    open_[np.arange(len(x)), home] = False
                    q, c = np.nonzero(open_)
                    for at in range(0, len(q), 10_000):
                        rows = q[at : at + 10_000]
                        yield pd.DataFrame({"uid": part["uid"].to_numpy()[rows], "cell": start + c[at : at + 10_000], "vec": part["vec"].to_numpy()[rows], "radius": part["radius"].to_numpy()[rows]})

    home = cut(asked(celled.withColumn("radius", F.lit(None).cast("double"))), sized=False)
    own = Window.partitionBy("uid").orderBy(F.desc("cosine"), "other")
    far = home.withColumn("r", F.row_number().over(own)).where(F.col("r") == k + 1).select("uid", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("cosine"))).alias("radius"))
    wide = celled.join(far, "uid", "left").select("uid", "cell", "vec", F.coalesce(F.col("radius"), F.lit(2.0)).alias("radius"))
    pairs = home.unionAll(asked(cut(wide.mapInPandas(reached, "uid long, cell long, vec array<float>, radius double"))))
    best = Window.partitionBy("uid").orderBy(F.desc("cosine"), "other")
    pairs = pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    # each unique vector's partners as ids: its own copies first (cosine 1), then the copies of the others
    copies = unique.select(F.col("uid").alias("other"), "ids")
    near = pairs.join(copies, "other").select("uid", F.when(F.col("other") == F.col("uid"), 2.0).otherwise(F.col("cosine")).alias("cosine"), F.explode("ids").alias("nbr_id"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("cosine"), "nbr_id"))).where(F.col("r") <= k + 1)
    lists = near.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("r", "nbr_id", "cosine"))).alias("near"))
    members = v.join(unique.select("uid", F.col("vec").alias("vec")), "vec").select("vec_id", "uid").join(lists, "uid")
    others = F.slice(F.filter("near", lambda x: x["nbr_id"] != F.col("vec_id")), 1, k)
    out = members.select("vec_id", F.explode(others).alias("x"))
    return out.select("vec_id", F.col("x.nbr_id").alias("nbr_id"), F.least(F.col("x.cosine"), F.lit(1.0)).alias("cosine"))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float32) if len(vectors) else np.zeros((0, 1), dtype=np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, nbr_id) of the ten most similar usable vectors of every usable vector."""
    usable = table(spark, sf_dir, "vectors").where(F.col("model_id") == "hash64-v1")
    return nearest_vectors(usable).select("vec_id", "nbr_id")


QUERIES = {"p2_found": p2_found}
# All pairs, exactly; equal at the sizes of the tests, where no neighbour is missed.
SQL = {
    "p2_found": """
WITH v AS (SELECT DISTINCT vec_id, vec::DOUBLE[] AS v FROM vectors WHERE model_id = 'hash64-v1' AND vec IS NOT NULL AND len(list_filter(vec, lambda x: x <> 0)) > 0),
     u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM v),
     c AS (SELECT a.vec_id, b.vec_id AS nbr_id, round(list_dot_product(a.v, b.v), 9) AS cosine FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v))
SELECT vec_id, nbr_id FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, nbr_id) <= 10
"""
}
