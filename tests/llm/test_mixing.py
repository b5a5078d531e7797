from __future__ import annotations

import os

import numpy as np
import pytest

from mnemospark.llm import mixing as M


def test_split_is_exact():
    rng = np.random.default_rng(0)
    for shards in (1, 2, 5, 16):
        parts = M.split_quotas([100, 7, 0, 33], shards, rng)
        assert len(parts) == shards and np.sum(parts, axis=0).tolist() == [100, 7, 0, 33]
        assert max(map(sum, parts)) - min(map(sum, parts)) <= 4


def test_shares_and_caps(spark):
    tokens = [("code", k, 50 + k % 90) for k in range(2_000)] + [("note", 10_000 + k, 20 + k % 40) for k in range(300)] + [("one", 20_000, 500)]
    T = spark.createDataFrame([(*r, 1) for r in tokens], "source string, doc_id long, tokens long, repeats long")
    plans = [("p", "Code ", 0.5, 1), ("p", "note", 0.5, 3), ("q", "code", 1.0, 2), ("none", "code", 0.5, 1), ("none", "gone", 0.5, 9), ("zero", "code", 1.0, 1), ("zero", "note", 0.0, 1), ("p", "note", 0.5, 3), (None, "code", 1.0, 1)]
    P = spark.createDataFrame(plans, "plan string, source string, target_share double, max_repeats long")
    mixed = M.mixture(T, P)
    per = mixed.groupBy("plan", "source", "doc_id").sum("repeats").collect()
    assert all(r["sum(repeats)"] <= {"p": {"code": 1, "note": 3}, "q": {"code": 2}, "zero": {"code": 1}}[r["plan"]][r["source"]] for r in per)
    got = {(r["plan"], r["source"]): r["actual_share"] for r in M.shares(mixed, P).where("plan is not null").collect()}
    assert abs(got["p", "code"] - 0.5) < 0.01 and abs(got["p", "note"] - 0.5) < 0.01 and got["q", "code"] == 1 and got["zero", "note"] == 0 and got["none", "code"] == 0
    whole = {r["plan"]: r["n"] for r in mixed.groupBy("plan").agg({"repeats": "sum"}).withColumnRenamed("sum(repeats)", "n").collect()}
    assert whole["q"] == 4_000 and whole["zero"] == 2_000
    assert sorted(map(tuple, M.mixture(T, P).collect())) == sorted(map(tuple, mixed.collect()))  # the same again
    assert M.mixture(T.limit(0), P).count() == 0 and M.mixture(T, P.limit(0)).count() == 0


def test_sources_beyond_the_plans(spark, monkeypatch):
    monkeypatch.setattr(M, "LEAST_BLOCKS", 2)
    T = spark.range(30_000).selectExpr("concat('s', id % 1500) as source", "id as doc_id", "10L as tokens")
    P = spark.createDataFrame([(f"p{k}", f"s{k}", 1.0, 1) for k in range(30)], "plan string, source string, target_share double, max_repeats long")
    got = {r["plan"]: r["count"] for r in M.mixture(T, P).groupBy("plan").count().collect()}
    assert got == {f"p{k}": 20 for k in range(30)}
    for bound in ("PLAN_ROWS", "PLAN_SOURCES"):
        with monkeypatch.context() as m:
            m.setattr(M, bound, 29)
            with pytest.raises(ValueError):
                M.mixture(T, P)


@pytest.mark.skipif(not os.path.exists(M.TOKENIZER), reason="no tokenizer files")
def test_tokens(spark):
    rows = [(1, " Note ", "hello world", "x"), (2, "note", "", "x"), (3, None, "a", "x"), (4, "note", None, "x"), (5, "code", "a " * 100_000, "x"), (1, "note", "hello world", "x")]
    got = {(r["source"], r["doc_id"]): r["tokens"] for r in M.count_tokens(spark.createDataFrame(rows, "doc_id long, source string, text string, tokens string")).collect()}
    assert got[("note", 1)] == 2 and got[("code", 5)] > 99_000 and len(got) == 2


def test_blocks_and_shards_follow_the_size_and_order_is_whole(spark, monkeypatch):
    for k, v in {"BLOCK_TOKENS": 50, "SHARD_TOKENS": 400, "LEAST_BLOCKS": 2, "LEAST_SHARDS": 2}.items():
        monkeypatch.setattr(M, k, v)
    T = spark.range(600).selectExpr("if(id < 500, 'a', 'b') as source", "id as doc_id", "10L as tokens")
    P = spark.createDataFrame([("p", "a", 0.5, 1), ("p", "b", 0.5, 3)], "plan string, source string, target_share double, max_repeats long")
    mixed = M.mixture(T, P)
    sizes = {r["shard"]: r["n"] for r in mixed.groupBy("shard").agg({"repeats": "sum"}).withColumnRenamed("sum(repeats)", "n").collect()}
    assert len(sizes) == 15 and sum(sizes.values()) == 600  # 6,000 tokens
    rows = M.ordered(mixed).collect()
    places: dict[int, list[int]] = {}
    for r in rows:
        places.setdefault(r["shard"], []).append(r["position"])
    assert {s: sorted(p) for s, p in places.items()} == {s: list(range(1, n + 1)) for s, n in sizes.items()}
    one = [r["doc_id"] for r in sorted(rows, key=lambda r: r["position"]) if r["shard"] == 3]
    assert one != sorted(one)
