from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from mnemospark.llm import near_duplicates as N


def brute(rows):
    sets = {(s, i): w for s, i, t in rows if t and i is not None and (w := frozenset(re.findall(r"\w+", t.lower())))}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for a in range(len(keys)):
        for b in range(a):
            x, y = sets[keys[a]], sets[keys[b]]
            if keys[a][0] == keys[b][0] and 5 * len(x & y) >= 4 * len(x | y):
                p, q = find(keys[a]), find(keys[b])
                parent[max(p, q)] = min(p, q)
    groups: dict = {}
    for k in keys:
        groups.setdefault(find(k), []).append(k)
    return {(k[0], k[1], g[1]) for g, m in groups.items() if len(m) > 1 for k in m}


def test_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "GROUP", 5)
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for family in range(40):
        base = rng.sample(words, rng.randrange(1, 45))
        for _ in range(rng.randrange(1, 12)):
            t = list(base)
            for _ in range(rng.randrange(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rng.shuffle(t)
            rows.append((rng.choice(["doc", "turn"]), len(rows), " ".join(t)))
    rows += [("doc", 900 + k, "the same words as ever") for k in range(60)]
    chain = [f"c{k}" for k in range(40)]
    rows += [("doc", 2000 + k, " ".join(chain[k : k + 20])) for k in range(20)]  # each like the next only
    rows += [("doc", 3000, None), ("doc", 3001, ""), ("doc", 3002, "!!"), ("doc", None, "the same words as ever"), ("turn", 3003, "alone here"), rows[0], rows[1]]
    df = spark.createDataFrame([(*r, 7) for r in rows], "src string, row_id long, text string, group_id long")
    got = {(r["src"], r["row_id"], r["group_id"]) for r in N.near_duplicate_groups(df).collect()}
    assert got == brute(rows)
    assert N.near_duplicate_groups(df.limit(0)).count() == 0


def test_bounds():
    for n in range(1, 60):
        for m in range(n, 80):
            least = N.least_overlap(n, m)
            assert 5 * least >= 4 * (n + m - least) and 5 * (least - 1) < 4 * (n + m - least + 1)
        assert N.least_overlap(n) == min(o for o in range(n + 1) if 5 * o >= 4 * n)


def test_alike_sets_share_a_column():
    rng = np.random.default_rng(3)
    for case in range(600):
        m = int(rng.integers(4, 400))
        n = min(int(m * rng.uniform(1, 1.25)), 5 * m // 4)
        common = N.least_overlap(n, m)
        if common > m:
            continue
        pool = rng.choice(1 << 62, size=n + m - common, replace=False).astype(np.uint64)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n:]]))
        share = rng.choice([0.0, 0.1, 0.5, 1.0])  # of rare tokens
        counts = {int(t): int(rng.integers(2, N.RARE + 1)) if rng.random() < share else N.RARE + 1 for t in pool}
        of = lambda t: np.array([counts[int(x)] for x in t], dtype=np.uint8)  # noqa: B023, E731
        other = np.sort(rng.choice(1 << 62, size=9, replace=False).astype(np.uint64))  # a set beside it changes nothing
        s, x = N.columns(np.concatenate([other, a]), np.concatenate([np.full(9, 3, np.uint8), of(a)]), np.array([9, len(a)]), False)
        x, y = x[s == 1], N.columns(b, of(b), np.array([len(b)]), True)[1]
        assert set(x.tolist()) & set(y.tolist()), (case, n, m, share)
        assert len(x) <= 8 * n + 100  # columns grow with the set, not with its square


def test_alike_is_exact():
    rng = random.Random(5)
    for _ in range(300):
        sets = [np.array(sorted(rng.sample(range(40), rng.randrange(1, 30))), dtype=np.uint64) for _ in range(4)]
        got = N.alike(sets[0], np.concatenate(sets[1:]), np.array([len(x) for x in sets[1:]]))
        t = set(sets[0].tolist())
        assert got.tolist() == [5 * len(t & set(x.tolist())) >= 4 * len(t | set(x.tolist())) for x in sets[1:]]


def test_no_join_sends_the_groups_by_a_guessed_size(spark, tmp_path):
    rows = [(k, " ".join(f"w{j}" for j in range(k, k + 30))) for k in range(40)]
    spark.createDataFrame(rows, "node long, text string").write.parquet(f"{tmp_path}/r")
    groups = N._grouped(spark.read.parquet(f"{tmp_path}/r"))
    joined = groups.join(groups.select("gid", F.col("label").alias("other")), "gid")
    assert joined.count() == groups.count() > 0
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
