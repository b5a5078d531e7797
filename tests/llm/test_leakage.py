from __future__ import annotations

import random

from mnemospark.llm import leakage as L


def test_as_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["Ärger", "x1", "한국"]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(5, 60)))) for k in range(30)]
    docs = []
    for k in range(120):
        body = rng.choices(words, k=rng.randrange(0, 80))
        if k % 2:
            w = items[rng.randrange(30)][1].split()
            n = rng.choice([10, 11, 12, 13, 30])
            at = rng.randrange(0, max(1, len(w) - n))
            body[len(body) // 2 : len(body) // 2] = [x.upper() for x in w[at : at + n]]
        docs.append((k, rng.choice([" ", "\n", "_", " -- "]).join(body), 5))
    docs.append((1, "one more text of document 1: " + items[7][1], 5))
    docs += [(500, None, 5), (501, "", 5), (None, items[0][1], 5), docs[1], (502, "pad " * 50_000 + items[3][1], 5)]
    want = {(d, i) for d, t, _ in docs if d is not None for i, s in items if L.passages(s) & L.passages(t)}
    D = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    I = spark.createDataFrame([*items, (99, None), items[0]], "item_id long, text string")  # noqa: E741
    assert want and {tuple(r) for r in L.find_leaks(D, I).collect()} == want
    monkeypatch.setattr(L, "SENT_MINIMA", 3)  # the way without sending the items' minima or the pairs
    monkeypatch.setattr(L, "SENT_PAIRS", 3)
    assert {tuple(r) for r in L.find_leaks(D, I).collect()} == want
    assert L.find_leaks(D, I.limit(0)).count() == 0 and L.find_leaks(D.limit(0), I).count() == 0


def test_p8_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "eval_items"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(map(tuple, L.p8_found(spark, sf).collect())) == sorted(con.sql(L.SQL["p8_found"]).fetchall())
