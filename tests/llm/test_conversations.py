from __future__ import annotations

import json

from mnemospark.llm.conversations import quote_links, rebuild_conversations

SCHEMA = "rec_id long, session_id string, agent string, type string, content string, timestamp string, machine string, is_meta boolean, is_sidechain boolean, pos string"
A = lambda t: json.dumps([{"type": "thinking", "thinking": "x"}, {"type": "text", "text": t}])
C = lambda role, t: json.dumps({"type": "message", "role": role, "content": [{"type": "input_text", "text": t}]})


def row(i, s, agent, kind, content, ts="auto", meta=None, side=None):
    return (i, s, agent, kind, content, f"2026-01-01T{(i or 0) % 24:02}:00:00.000Z" if ts == "auto" else ts, None, meta, side, "clash")


def run(spark, rows, replies=None):
    m = spark.createDataFrame([], "machine string, tz string, date_order string")
    out: dict = {}
    for r in rebuild_conversations(spark.createDataFrame(rows, SCHEMA), m, replies).orderBy("session_id", "pos").collect():
        out.setdefault(r["session_id"], []).append((r["pos"], r["rec_id"], r["role"]))
    return out


def test_kept_and_broken(spark):
    rows = [
        row(1, "ok", "claude", "user", "Hi"), row(2, "ok", "claude", "assistant", A("a")), row(3, "ok", "claude", "user", "Caveat: x"), row(4, "ok", "claude", "user", "More <system-reminder>no</system-reminder>"),
        row(5, "ok", "claude", "assistant", A("b")), row(6, "ok", "claude", "assistant", A("c")), row(7, "ok", "claude", "user", "meta", meta=True), row(8, "ok", "claude", "user", "side", side=True),
        row(11, "ok", "claude", "assistant", A("a"), ts="2026-01-01T02:00:00.000Z"), row(2, "ok", "claude", "assistant", A("a")), row(12, "ok", "claude", "assistant", "[{cut"), row(13, "ok", "claude", "assistant", "plain"),
        row(1, "starts-wrong", "codex", "response_item", C("assistant", "x")), row(2, "starts-wrong", "codex", "response_item", C("user", "x")), row(3, "starts-wrong", "codex", "response_item", C("assistant", "x")),
        row(1, "no-reply", "codex", "response_item", C("user", "q")), row(2, "no-reply", "codex", "response_item", C("user", "q2")), row(3, "no-reply", "codex", "response_item", C("assistant", "x")),
        row(1, "ends", "gemini", "user", "q"), row(2, "ends", "gemini", "gemini", "a"), row(3, "ends", "gemini", "user", "q"),
        row(1, "no-time", "gemini", "user", "q"), row(2, "no-time", "gemini", "gemini", "a", ts="soon"), row(1, "empty", "gemini", "user", "<session_context>x</session_context>"), row(2, "empty", "gemini", "info", "x"),
        row(20, "late", "gemini", "gemini", '[{"text": "a"}]', ts="2026-01-03T00:00:00Z"), row(21, "late", "gemini", "user", '[{"text": "q"}]', ts="1767312000"), row(22, "late", "gemini", "gemini", None), row(None, "late", "gemini", "user", "x"),
    ]
    got = run(spark, rows)
    assert got == {"ok": [(1, 1, "user"), (2, 2, "assistant"), (3, 4, "user"), (4, 5, "assistant"), (5, 6, "assistant")], "late": [(1, 21, "user"), (2, 20, "assistant")]}


def test_rows_without_identifier(spark):
    rows = [
        row(1, None, "gemini", "user", "Where is the lantern of the harbor?"), row(2, " ", "gemini", "gemini", "> Where is the lantern of the harbor?\nOn the left."), row(3, None, "gemini", "user", "And the other?"),
        row(4, None, "gemini", "gemini", "On the right."), row(9, None, "gemini", "user", "Lonely question without any answer"),
    ]
    replies = spark.createDataFrame([(3, 2), (4, 3), (4, 77)], "a long, b long")
    assert run(spark, rows, replies) == {"component:1": [(1, 1, "user"), (2, 2, "assistant"), (3, 3, "user"), (4, 4, "assistant")]}


def test_no_records(spark):
    assert run(spark, []) == {}


def test_long_session_in_one_hour_and_over_many(spark):
    rows = []
    for k in range(400):
        rows.append(row(k, "hot", "gemini", "user" if k % 2 == 0 else "gemini", f"text {k}", ts=str(1_760_000_000 + k * (1 if k < 200 else 977))))
    got = run(spark, rows)["hot"]
    assert [p for p, _, _ in got] == list(range(1, 401)) and [i for _, i, _ in got] == list(range(400))


def test_a_log_without_any_session_is_rebuilt(spark, sf):
    """Recall and precision of the conversations found by reply links alone, against the sessions of the log."""
    from mnemospark.llm.conversations import p6_found, p6_linked

    want, got = ({(r["rec_id"], r["role"]): r["session_id"] for r in q(spark, sf).collect()} for q in (p6_found, p6_linked))
    by = lambda d: {(a, b) for s in set(d.values()) for m in [sorted(k[0] for k, v in d.items() if v == s)] for a, b in zip(m, m[1:], strict=False)}
    assert len(by(want) & by(got)) >= 0.99 * len(by(want))


def test_a_stock_phrase_links_only_the_latest(spark):
    said = "> The same words as on every other day\nx"
    rows = [(1, said[2:], 0), (2, said[2:], 3_600_000_000), (3, said, 7_200_000_000), (4, said, 400_000_000_000), (5, "> short\nx", 1), (6, said, None)]
    m = spark.createDataFrame(rows, "rec_id long, text string, us long")
    assert [tuple(r) for r in quote_links(m).collect()] == [(3, 2)]
