from __future__ import annotations

import random

from mnemospark.llm.nearest_time import MINUTE, SECOND, nearest_in_time


def test_as_brute_force(spark):
    rng = random.Random(2)
    at = lambda: rng.choice([rng.randrange(0, 40 * MINUTE), rng.randrange(0, 40) * MINUTE, rng.randrange(10 * MINUTE, 10 * MINUTE + 3 * SECOND)])
    left = [(k, rng.choice("abc"), at()) for k in range(300)] + [(900, None, 5), (901, "a", None), (902, "zz", 5)]
    right = [(rng.choice("abc"), at(), f"k{k:03}") for k in range(250)] + [("a", None, "n"), (None, 3, "n"), ("a", 5, None)]
    right += right[:40]
    L = spark.createDataFrame([(*r, "x") for r in left], "lid long, entity string, t long, key string")
    R = spark.createDataFrame(right, "entity string, t long, key string")
    for back, forward, tick in ((0, 6 * MINUTE, MINUTE), (4 * MINUTE, 4 * MINUTE, MINUTE), (3 * MINUTE, 0, 7 * SECOND), (90 * SECOND, 90 * SECOND, 10 * MINUTE)):
        want = set()
        for i, e, t in left:
            if e is None or t is None:
                continue
            c = [(abs(u - t), u, k) for f, u, k in right if f == e and u is not None and k is not None and -back <= u - t <= forward]
            if c:
                want.add((i, min(c)[2]))
        got = [(r["lid"], r["key"]) for r in nearest_in_time(L, R, back_us=back, forward_us=forward, tick_us=tick).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert nearest_in_time(L, R.limit(0), back_us=1, forward_us=1, tick_us=SECOND).count() == 0
    assert nearest_in_time(L.limit(0), R, back_us=1, forward_us=1, tick_us=SECOND).count() == 0
