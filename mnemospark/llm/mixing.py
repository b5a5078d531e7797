"""Problem 9: sources mixed to target shares of tokens, with a cap on repeats.

Each source's documents are permuted by a seeded hash and cut into blocks of about BLOCK_TOKENS. The block quotas that
meet the shares are split among the output shards by a multivariate-hypergeometric tree: a node's blocks are drawn
without replacement for its left half, by source, until a leaf is one shard with exact quotas of every source. A shard
then draws the next disjoint run of each source's permuted blocks. ``ordered`` shuffles a shard's documents locally, by
a seeded hash. Blocks and shards follow from the size of the sources, so that each fits a task; only block sums reach
the driver.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of a block and of an output shard (a few hundred megabytes of text), and the fewest blocks of a source and shards.
BLOCK_TOKENS, SHARD_TOKENS = 32_000_000, 128_000_000
LEAST_BLOCKS, LEAST_SHARDS = 512, 16
#: Most blocks of all sources, whose sums the driver holds; beyond that blocks get larger.
MOST_BLOCKS = 1_000_000
#: Most plan rows and most sources of all plans; more raise, as they would not fit the driver.
PLAN_ROWS, PLAN_SOURCES = 100_000, 1_000
SEED = 7


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(source, doc_id, tokens) of every document (doc_id, source, text) with a source and at least one token; sources are lower-case and trimmed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(path).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"source": b["source"], "doc_id": b["doc_id"], "tokens": [len(encode(t)) for t in b["text"]]})

    d = documents.select(F.lower(F.trim("source")).alias("source"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    d = d.where("source is not null and source <> '' and doc_id is not null and text is not null")
    counted = d.mapInPandas(run, "source string, doc_id long, tokens long").where("tokens > 0")
    return counted.groupBy("source", "doc_id").agg(F.max("tokens").alias("tokens"))


def split_quotas(quotas: list[int], shards: int, rng: np.random.Generator) -> list[list[int]]:
    """The quotas of each shard: exact splits of ``quotas`` by multivariate-hypergeometric draws down a binary tree."""
    if shards == 1:
        return [list(quotas)]
    half = shards // 2
    draw = round(sum(quotas) * half / shards)
    left = rng.multivariate_hypergeometric(quotas, draw).tolist() if sum(quotas) else [0] * len(quotas)
    return split_quotas(left, half, rng) + split_quotas([a - b for a, b in zip(quotas, left, strict=True)], shards - half, rng)


def mixture(tokens: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan, shard, source, doc_id, tokens, repeats): the documents chosen for each plan; ``repeats`` are those in the shard.

    ``tokens``: (source, doc_id, tokens); ``plans``: (plan, source, target_share, max_repeats). The total is the
    largest for which no source with a share needs a document more often than its cap. A source with share 0 or NULL,
    a cap below 1 or no documents has no rows (and in the latter cases the plan has none, as its shares can't be met);
    repeated plan rows count once; too many plan rows or sources raise ValueError. A source's last block is used up to the document that reaches the quota.
    """
    spark = tokens.sparkSession
    rows = plans.select("plan", F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").dropna().distinct().limit(PLAN_ROWS + 1).collect()
    wanted: dict[str, dict[str, tuple[float, int]]] = {}
    for r in rows:
        if r["target_share"] > 0:
            wanted.setdefault(r["plan"], {})[r["source"]] = (r["target_share"], int(r["max_repeats"]))
    used = sorted({s for of in wanted.values() for s in of})
    if len(rows) > PLAN_ROWS or len(used) > PLAN_SOURCES:
        raise ValueError(f"more than {PLAN_ROWS} plan rows or {PLAN_SOURCES} sources in plans")
    if not used:
        return tokens.select(F.lit("").alias("plan"), F.lit(0).alias("shard"), "source", "doc_id", "tokens", F.lit(1).cast("long").alias("repeats")).limit(0)
    named = F.broadcast(spark.createDataFrame([(s,) for s in used], "source string"))
    kept = cut(tokens.join(named, "source", "left_semi").select("source", "doc_id", "tokens"))
    sizes = {r["source"]: r["n"] for r in kept.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    of_block = max(BLOCK_TOKENS, -(-sum(sizes.values()) // MOST_BLOCKS))
    blocks = {s: max(LEAST_BLOCKS, -(-n // of_block)) for s, n in sizes.items()}
    counts = F.broadcast(spark.createDataFrame(list(blocks.items()) or [("", 1)], "source string, blocks long"))
    hashed = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.col("blocks")).alias("block")
    blocked = kept.join(counts, "source").select("source", "doc_id", "tokens", hashed)
    sums: dict[str, dict[int, int]] = {s: {} for s in used}
    for r in blocked.groupBy("source", "block").agg(F.sum("tokens").alias("n")).toLocalIterator():
        sums[r["source"]][r["block"]] = r["n"]
    taken: list[tuple[str, int, str, int, int, float]] = []
    for plan in sorted(wanted):
        of = wanted[plan]
        whole = sum(share for share, _ in of.values())
        total = min(cap * sizes.get(s, 0) * whole / share for s, (share, cap) in of.items())
        if total <= 0:
            continue
        names = sorted(of)
        rng = np.random.default_rng([SEED, *plan.encode()])
        runs, quotas = {}, []
        for s in names:  # the blocks of all passes in permuted order, up to the one that reaches the quota
            order = sorted(sums[s])
            rng.shuffle(order)
            left, run = total * of[s][0] / whole, []
            for _pass in range(of[s][1]):
                for b in order:
                    if left < 0.5:
                        break
                    run.append((b, min(1.0, left / sums[s][b])))
                    left -= sums[s][b]
            runs[s] = run
            quotas.append(len(run))
        at = dict.fromkeys(names, 0)
        shards = max(LEAST_SHARDS, int(-(-total // SHARD_TOKENS)))
        for shard, parts in enumerate(split_quotas(quotas, shards, rng)):
            for s, n in zip(names, parts, strict=True):
                for b, part in runs[s][at[s] : at[s] + n]:
                    taken.append((plan, shard, s, b, 1, part))
                at[s] += n
    drawn = spark.createDataFrame(taken, "plan string, shard int, source string, block long, times int, part double")
    full = drawn.where("part >= 1").groupBy("plan", "shard", "source", "block").agg(F.sum("times").alias("repeats"))
    rest = drawn.where("part < 1").select("plan", "shard", "source", "block", "part")
    keys = ["source", "block"]
    chosen = blocked.join(full, keys).select("plan", "shard", "source", "doc_id", "tokens", F.col("repeats").cast("long"))
    inside = Window.partitionBy("plan", "source", "block").orderBy(F.xxhash64(F.lit(SEED + 1), "doc_id"), "doc_id")
    partial = blocked.join(rest, keys).withColumns(
        {"before": F.sum("tokens").over(inside) - F.col("tokens"), "size": F.sum("tokens").over(Window.partitionBy("plan", "source", "block"))}
    )
    partial = partial.where(F.col("before") + F.col("tokens") / 2 <= F.col("part") * F.col("size"))
    return chosen.unionAll(partial.select("plan", "shard", "source", "doc_id", "tokens", F.lit(1).cast("long").alias("repeats")))


def ordered(mixed: DataFrame) -> DataFrame:
    """(plan, shard, position, source, doc_id): every use of a document in a shard at its place, by a seeded hash. A
    shard has about SHARD_TOKENS tokens, which one task sorts. Rows of ``mixture``; equal hashes are ordered by document."""
    every = mixed.select("plan", "shard", "source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("use"))
    w = Window.partitionBy("plan", "shard").orderBy(F.xxhash64(F.lit(SEED + 2), "plan", "shard", "source", "doc_id", "use"), "source", "doc_id", "use")
    return every.select("plan", "shard", F.row_number().over(w).cast("long").alias("position"), "source", "doc_id")


def shares(mixed: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan, source, target_share, tokens, actual_share) of every plan row; sources that give nothing have 0."""
    got = mixed.groupBy("plan", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    got = got.withColumn("actual_share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy("plan")))
    p = plans.select("plan", F.lower(F.trim("source")).alias("source"), "target_share").distinct()
    out = p.join(got, ["plan", "source"], "left")
    return out.select("plan", "source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce("actual_share", F.lit(0.0)), 6).alias("actual_share"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(count_tokens(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_plans"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan, source, doc_id, tokens, repeats): the chosen documents of every plan with their repeat counts over all shards."""
    mixed = _mixed(spark, sf_dir)
    return mixed.groupBy("plan", "source", "doc_id").agg(F.max("tokens").alias("tokens"), F.sum("repeats").alias("repeats"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan, source, target_share, tokens, actual_share) of every plan."""
    return shares(_mixed(spark, sf_dir), table(spark, sf_dir, "mix_plans"))


def p9_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan, shard, position, source, doc_id): every shard of every plan in its shuffled order."""
    return ordered(_mixed(spark, sf_dir))


def p9_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan, source, share_met, within_cap): whether each plan row's share is met within its largest document and no
    document is used more often than its cap, from the mixture of all documents."""
    mixed, plans = cut(_mixed(spark, sf_dir)), table(spark, sf_dir, "mix_plans").distinct()
    plans = plans.select("plan", F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats")
    use = mixed.groupBy("plan", "source", "doc_id").agg(F.max("tokens").alias("tokens"), F.sum("repeats").alias("repeats"))
    got = use.groupBy("plan", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("n"), F.max("tokens").alias("longest"), F.max("repeats").alias("most"))
    got = plans.join(got, ["plan", "source"], "left").withColumn("total", F.sum("n").over(Window.partitionBy("plan")))
    met = F.abs(F.coalesce("n", F.lit(0)) - F.col("target_share") * F.col("total")) <= F.coalesce("longest", F.lit(0)) + 1
    return got.select("plan", "source", met.alias("share_met"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"))


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares, "p9_order": p9_order, "p9_checked": p9_checked}
# Tokens can't be counted in SQL: the properties that the mixture must have, for every plan row.
SQL = {"p9_checked": "SELECT DISTINCT plan, lower(trim(source)) AS source, true AS share_met, true AS within_cap FROM mix_plans"}
