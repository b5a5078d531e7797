from __future__ import annotations

import pytest

from mnemospark.llm.pairs import breaks_off, defect, flag_pairs, is_refusal, language, tiled

Q = "How should the harbor loader behave when the lantern list is empty after the merge of both tables?"
A = "The loader skips the lantern list and writes a warning, as the merge of both tables has filled it before."
CASES = [
    (Q, None, "empty"), (Q, "  \n\t", "empty"), (Q, "N/A", "empty"), (Q, "```\n```", "empty"), (Q, "​", "empty"), (None, A, "empty"), (Q, A, None), (Q, "Yes.", None), (Q, "Done.", None), (Q, "Not yet.", None),
    (Q, A + " Then it waits for the", "truncated"), (Q, A + "\n```python\ndef f(", "truncated"), (Q, A + "\n```python\ndef f():\n  pass\n```", None), (Q, A + "\n- first/of.py\n- load_harbor", None),
    (Q, A + "\n- src/harbor/lan", "truncated"), (Q, A + " See (the second", "truncated"), (Q, A + " If,", "truncated"), (Q, "I'm sorry, but I can't help with this.", "refusal"), (Q, "Hm. I have to refuse. It might be unsafe.", "refusal"),
    (Q, "Sorry for the delay: the loader refused the connection until the table was there.", None), ("Wie geht das mit der Tabelle und dem Hafen?", "Dabei kann ich leider nicht helfen.", "refusal"),
    (Q, Q, "copy"), (Q, "You asked: " + Q.lower(), "copy"), (Q, f"**{Q}**", "copy"), (Q, f"{Q}\n\n{Q}", "copy"), (Q, f"> {Q}\n\n{A}", None),
    (Q, "Der Test deckt alle Fälle ab und die Tabelle ist nicht mehr leer, denn das war von Hand eingetragen.", "language"), (Q + " Please answer in German.", "Der Test deckt alle Fälle ab und die Tabelle ist nicht mehr leer, denn das war von Hand.", None),
    (Q, "이제 테스트는 모든 사례를 포함합니다. 값은 나중에 저장됩니다.", "language"), (Q, A + "\n```\nder die das und nicht\n```", None),
]


@pytest.mark.parametrize("q,a,want", CASES)
def test_defects(q, a, want):
    assert defect(q, a) == want


def test_tiling():
    assert tiled("a b c d e".split(), "c d e a b c".split()) == 6 and tiled("a b".split(), "a b".split()) == 0 and tiled([], ["a"]) == 0


def test_parts():
    assert language("") == "" and breaks_off("one\n```\ncode") and not breaks_off("Fine.")
    assert not breaks_off("x" * 100_000 + ".")


def test_over_a_table(spark):
    rows = [(1, Q, "null", "x"), (1, Q, "null", "x"), (2, Q, A, "x"), (None, Q, None, "x"), (3, None, None, "x")]
    df = spark.createDataFrame(rows, "turn_id long, question string, answer string, defect string")
    assert sorted(map(tuple, flag_pairs(df).collect())) == [(1, "empty"), (3, "empty")]
    assert flag_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        "**Use the cache", "<div><p>Use it now.", "The call (which\nspans lines\nends.", "Run `make all and wait.", "There are 3 steps:\n1. Open it.\n2. Close it.", "See src/core/window_pane.",
        "Es sind 2 Schritte:\n1. Erst lesen.", "```\nx = 1", "It reads “the first line. And so on.", "The value is ~~old. It moves.",
    ],
)
def test_breaks_off(text):
    assert breaks_off(text)


@pytest.mark.parametrize(
    "text",
    [
        "**Use the cache** and go.", "<p>Use it now.</p>", "a) first one\nb) second one.", "There are 2 steps:\n1. Open it.\n2. Close it.", "A (long\nbracket) closes.", "Set `x[0` first.", "An open (bracket.\n\nA later paragraph.",
        "See src/core/window_pane.py.", "Done.", "```\nf(x[\n```", "The list<string> type is fine.", "src/a/b.py",
    ],
)
def test_is_whole(text):
    assert not breaks_off(text)


@pytest.mark.parametrize(
    "text",
    [
        "I'm afraid that falls outside of what I may do.", "That falls outside of what I may do.", "I don't feel comfortable answering that.", "We are not able to share this.", "Sorry, but I won't go into that.",
        "Je ne peux pas vous aider avec cela.", "Das kann ich leider nicht beantworten.", "Debo negarme.", "Unfortunately, I must respectfully decline.", "I'm not comfortable discussing it.",
    ],
)
def test_refusals_in_other_words(text):
    assert is_refusal(text)


@pytest.mark.parametrize("text", ['The log says "I cannot help with that" twice.', "It prints `I can't do that` and ends.", "I can't see a caller, so it is safe.", "> I cannot help with that\nFixed.", "I couldn't reproduce it at first."])
def test_no_refusals(text):
    assert not is_refusal(text)


def test_tiling_is_fast_on_long_alike_texts():
    import random
    import time

    rng = random.Random(2)
    q = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    began = time.time()
    assert tiled(q, q) == len(q) and tiled(q, q[10_000:] + ["x"] * 50 + q[:10_000]) == len(q) and tiled(q, ["y"] * 20_000) == 0
    assert time.time() - began < 30 and tiled("a b c d e f".split(), "d e f x a b c a b".split()) == 6
