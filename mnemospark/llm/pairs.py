"""Problem 7: question-answer pairs that are no use, each with its defect.

A pushdown parser over the whole answer tells answers that break off: fences, announced lists and, in the last block
of prose, brackets, quotations, inline code, emphasis and markup must be closed. Greedy string tiling tells answers
that only give the question back; refusal grammars and script and function-word checks tell the rest. Tests go from
the surest to the weakest, and a turn has one defect.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

# Answers that stand for nothing.
STAND_INS = {
    "", "none", "null", "nil", "n/a", "na", "-", "--", "---", "…", "...", "..", ".", "(no output)", "(empty)", "(none)", "[]", "{}", "()", '""', "''",
    "no output", "no answer", "no response", "undefined", "nan", "tbd", "todo", "?", "[no content]", "(no content)", "없음", "keine", "keine antwort", "sin respuesta", "ninguno",
}
_INVISIBLE = re.compile(r"[\s­​-‏⁠﻿]+")

# Parts of refusals, by language: who, that they don't, what they don't do, and to what.
_VERB = r"(?:help|assist|answer|comply|provide|continue|do|share|support|respond|discuss|fulfil|fulfill|go into|talk about|engage|carry out|take)"
_ING = r"(?:helping|assisting|answering|complying|providing|continuing|doing|sharing|supporting|responding|discussing|going into|talking about|engaging)"
_OBJECT = r"(?:you\s+)?(?:with\s+|to\s+|on\s+|in\s+|about\s+)?(?:that|this|it|these|those|your (?:request|question)|such\b)"
_NOT = r"(?:can['’]?t|cannot|can not|won['’]?t|will not|must not|may not|shouldn['’]?t|(?:am|are|['’]m|['’]re) (?:not able|unable|not allowed|not permitted|not going|not willing|not in a position) to)"
_REFUSE = r"(?:decline|refuse|pass on|turn (?:that|this|it) down)"
_PARTS = {
    "en": [
        rf"(?:(?:i['’]?m|i am|we are|we['’]re)\s+)?(?:very |so |really )?sorry,?\s*(?:but\s+)?(?:i|we)\s*{_NOT}\s+{_VERB}\b",
        rf"(?:i|we)\s*{_NOT}\s+{_VERB}\s+{_OBJECT}",
        rf"(?:i|we)\s*(?:am|are|['’]m|['’]re)\s+(?:not able|unable|not allowed|not permitted)\s+to\s+{_VERB}\b",
        rf"(?:i|we)\s+(?:have to|must|need to|will have to|shall|['’]ll have to)\s+(?:respectfully\s+)?{_REFUSE}\b",
        rf"(?:that|this|it)\s+is\s+something\s+(?:that\s+)?(?:i|we)\s+(?:must|have to|need to)\s+{_REFUSE}",
        rf"i(?:['’]d| would)\s+(?:rather|prefer)\s+not\b",
        rf"(?:i|we)\s+(?:don['’]?t|do not)\s+feel\s+comfortable\s+(?:with\s+)?{_ING}",
        rf"(?:i|we)(?:\s+am|\s+are|['’]m|['’]re)\s+not\s+comfortable\s+(?:with\s+)?{_ING}",
        r"(?:my )?apologies,?\s*(?:but\s+)?(?:this|that|it)\s+is\s+(?:outside|beyond|not something)",
        r"(?:this|that|it|your (?:request|question)|(?:this|that) (?:request|question))\s+(?:is|falls|lies|goes)\s+(?:well\s+)?(?:outside|beyond)\s+(?:of\s+)?(?:what\s+(?:i|we)\s+(?:can|may|am|are)|my\b|our\b)",
        r"(?:this|that|your)\s+(?:request|question)\s+(?:goes against|violates|is against|conflicts with)\s+(?:my|our)\b",
        r"as an? (?:ai|automated|virtual|language)\b.*\b(?:can['’]?t|cannot|not able|unable|don['’]?t have|not permitted|not allowed)",
        rf"(?:i|we)\s+(?:won['’]?t|will not)\s+be\s+able\s+to\s+{_VERB}\b",
    ],
    "de": [
        r"(?:diese[nrs]?|die)\s+(?:anfrage|frage|bitte)\s+muss\s+ich\s+(?:leider\s+)?(?:ablehnen|zurückweisen)|das\s+muss\s+ich\s+(?:leider\s+)?(?:ablehnen|verweigern)",
        r"(?:dabei|damit|hierbei)\s+(?:kann|darf)\s+ich\s+(?:dir\s+|ihnen\s+)?(?:leider\s+)?nicht\s+(?:weiter)?(?:helfen|dienen)|(?:leider\s+)?kann\s+ich\s+(?:dir|ihnen|dabei)\s+.{0,20}nicht\s+helfen",
        r"(?:dazu|darüber|hierzu)\s+(?:möchte|kann|darf)\s+ich\s+(?:leider\s+)?(?:keine\s+auskunft|nichts\s+sagen)",
        r"(?:es\s+tut\s+mir\s+leid,?\s*(?:aber\s+)?)?das\s+(?:darf|kann|werde)\s+ich\s+(?:leider\s+)?nicht(?:\s+(?:tun|machen|beantworten))?\s*[.!]?$",
    ],
    "es": [
        r"(?:lo\s+siento,?\s*)?(?:pero\s+)?no\s+puedo\s+(?:ayudar|responder|continuar|hacer|proporcionar|contestar)\w*\s+(?:con\s+)?(?:eso|esto|esta|a\s+esto|a\s+eso)",
        r"no\s+me\s+está\s+permitido\s+(?:responder|ayudar|contestar)|prefiero\s+no\s+(?:continuar|responder|seguir|contestar)|debo\s+(?:rechazar|negarme)\b|tengo\s+que\s+(?:rechazar|negarme)\b",
    ],
    "fr": [
        r"(?:je\s+suis\s+)?(?:désolée?,?\s*)?(?:mais\s+)?je\s+ne\s+(?:peux|puis|suis\s+pas\s+en\s+mesure\s+de|suis\s+pas\s+autorisée?\s+à)\s*(?:pas\s+)?(?:vous\s+|t['’])?(?:aider|répondre|continuer|faire|fournir)",
        r"je\s+(?:dois|préfère)\s+(?:refuser|décliner|ne\s+pas)",
    ],
    "ko": [
        r".{0,25}(?:도와드릴|답변드릴|답변할|응할|제공할|처리할|도와줄|알려드릴)\s*수\s*(?:가\s*)?없(?:습니다|는\s*요청|어요)|.{0,20}거절(?:해야\s*합니다|하겠습니다|합니다)",
    ],
}
REFUSALS = re.compile(
    r"(?i)^(?:(?:oh|hm+|well|no|look|thanks?|ok(?:ay)?|and|but|leider|lamentablemente),?\s+)?(?:(?:unfortunately|regrettably|sadly|i['’]m afraid(?: that)?|i am afraid(?: that)?),?\s+)?(?:" + "|".join(x for parts in _PARTS.values() for x in parts) + ")"
)

_FENCE = re.compile(r"^\s*(```+|~~~+)(.*)$")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+(.*)$")
_END = re.compile(r"[.!?。！？]['\"”’)\]*_`»]*$")
_BASE, _PRIME = 1_000_003, (1 << 61) - 1
_PATH = re.compile(r"^[\w-]+(?:/[\w.-]+)+$")


_ANNOUNCED = re.compile(r"^(?:\D{0,40}\s)?(\d{1,2})(?!\d)[^\d.!?]{0,40}:$")
_NUMBER = re.compile(r"^\s*(\d{1,3})[.)]\s+\S")
_CUT_PATH = re.compile(r"(?:^|\s)[\w-]+(?:/[\w-]+){2,}\.$")
# Markup that is closed by an end tag.
_MARKUP = set("a b i em strong code pre p div span ul ol li table thead tbody tr td th h1 h2 h3 h4 h5 h6 details summary blockquote sub sup u s".split())
_MARK = re.compile(r"\*\*|~~|</?[a-z][a-z0-9]*(?:\s[^<>\n]*)?>|[()\[\]{}“”«»\"`]|(?<=\d)\"")
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}


def parse(answer: str) -> tuple[list[str], list[str]]:
    """(what is open at the end, lines of prose): a pushdown parser over the whole text.

    Fences hold everything up to their end. A line that announces a number of steps opens a list, which its last step
    closes. Inline marks belong to a block: a paragraph or a list item; what a block leaves open, only the end of the
    text makes a defect. A closing mark without its opening one (as in enumerations) is no mark.
    """
    fence, steps, inline = "", 0, []
    prose: list[str] = []
    last = ""
    for line in answer.rstrip().split("\n"):
        f = _FENCE.match(line)
        if fence:
            if f and f[1][0] == fence[0] and len(f[1]) >= len(fence) and not f[2].strip():
                fence, last = "", "fence"
            continue
        if f:
            fence, last, inline = f[1], "open", []
            continue
        bare = line.strip()
        if not bare:
            inline = []
            continue
        last = "prose"
        prose.append(bare)
        number = _NUMBER.match(line)
        if number and steps:
            steps = 0 if int(number[1]) >= steps else steps
        elif (m := _ANNOUNCED.match(bare)) and len(bare) < 60:
            steps = int(m[1])
        elif steps and not _ITEM.match(line) and prose[-2:-1] and _ANNOUNCED.match(prose[-2]):
            steps = 0  # no list follows
        if _ITEM.match(line):
            inline = []
        for mark in _MARK.findall(bare):
            if mark[0] == "<":
                name = re.match(r"</?([a-z0-9]+)", mark)[1]
                if name in _MARKUP and "`" not in inline:
                    _close(inline, "<" + name) if mark[1] == "/" else inline.append("<" + name)
            elif inline and inline[-1] == "`" and mark != "`":
                continue
            elif mark in _PAIRS:
                _close(inline, _PAIRS[mark])
            elif mark in ("**", "~~", "`", '"') and mark in inline:
                _close(inline, mark)
            else:
                inline.append(mark)
    open_ = ([fence] if fence else []) + (["steps"] if steps and last == "prose" and _NUMBER.match(prose[-1]) else [])
    return open_ + (inline if last == "prose" else []), prose if last == "prose" else []


def _close(stack: list[str], mark: str) -> None:
    """Pops up to the mark, if it is open."""
    if mark in stack:
        del stack[len(stack) - 1 - stack[::-1].index(mark) :]


def breaks_off(answer: str) -> bool:
    """Whether the text ends before its end: something is open, or its last item, path or sentence is cut short."""
    open_, prose = parse(answer)
    if open_:
        return True
    if not prose:
        return False
    last = prose[-1]
    item = _ITEM.match(last)
    tail = item[1].strip() if item else last
    bare = tail.strip("*_`")
    if not bare or re.search(r"[,;:({\[=\-–—/+&|<]$", bare) or _CUT_PATH.search(tail):
        return True
    if tail.endswith(("`", ">")):  # closed inline code or markup is an end
        return False
    if item:
        if re.fullmatch(r"[\w./-]+", bare):
            return bool(_PATH.match(bare)) and "." not in bare.rsplit("/", 1)[1]
        return len(bare.split()) > 3 and not _END.search(tail) and any(_END.search(p) for p in prose[:-1] if _ITEM.match(p))
    if _END.search(tail):
        return False
    if re.fullmatch(r"[\w./-]+", bare):  # a name alone is a whole answer
        return len(prose) > 1 and not _ITEM.match(prose[-2])
    return len(bare.split()) > 3 or len(bare) > 25


def is_refusal(answer: str) -> bool:
    """Whether a sentence of the answer, outside fences, inline code and quotations, declines to answer."""
    text = re.sub(r"```.*?(?:```|$)", " ", answer, flags=re.S)
    text = re.sub(r"(?<=\w)[^\S\n]+(?:\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|`[^`\n]*`)|(?m:^>.*$)", " ", text)
    for s in re.split(r"(?<=[.!?。])\s+|\n+", text):
        s = s.strip(" *_-\"'`“”")
        if s and REFUSALS.search(s):
            return True
    return False


def tiled(question: list[str], answer: list[str], least: int = 3) -> int:
    """Words of ``answer`` covered by greedy string tiling with ``question``: longer common runs first (by rolling
    hashes of runs that get shorter by a third), each question word used once per pass; a further pass starts when the
    question is used up, so that repeats count."""
    codes: dict[str, int] = {}
    q, a = ([codes.setdefault(w, len(codes) + 1) for w in x] for x in (question, answer))
    covered = [False] * len(a)

    def runs(x: list[int], used: list[bool], s: int) -> Iterator[tuple[int, int]]:
        """(hash, start) of every run of ``s`` unused words."""
        h = since = 0
        top = pow(_BASE, s, _PRIME)
        for i, w in enumerate(x):
            if used[i]:
                h = since = 0
                continue
            h, since = (h * _BASE + w) % _PRIME, since + 1
            if since > s:
                h = (h - x[i - s] * top) % _PRIME
            if since >= s:
                yield h, i - s + 1

    while True:
        used, s, before = [False] * len(q), min(len(q), len(a)), sum(covered)
        while s >= least:
            at: dict[int, list[int]] = {}
            for h, i in runs(q, used, s):
                at.setdefault(h, []).append(i)
            for h, j in list(runs(a, covered, s)):
                if any(covered[j : j + s]):
                    continue
                for i in at.get(h, ())[:8]:
                    if not any(used[i : i + s]) and q[i : i + s] == a[j : j + s]:
                        n = s
                        while i + n < len(q) and j + n < len(a) and q[i + n] == a[j + n] and not used[i + n] and not covered[j + n]:
                            n += 1
                        used[i : i + n], covered[j : j + n] = [True] * n, [True] * n
                        break
            s = max(least, s * 2 // 3) if s > least else 0
        if sum(covered) == before or all(covered):
            return sum(covered)


_LEAD = re.compile(
    r"(?i)^\s*(?:you(?:['’]ve)? asked|your question(?: was| is)?|the question(?: is| was)?|question|q|die frage(?: lautet| ist| war)?|frage|deine frage(?: war| lautet)?|la pregunta(?: es| era)?|pregunta|preguntaste|has preguntado|질문(?:은|하신 내용은)?(?: 다음과 같습니다)?)\s*[:：-]\s*"
)


def is_copy(question: str, answer: str) -> bool:
    """Whether the answer only gives the question back, whole or nearly, once or more, with or without markup."""
    q = re.findall(r"\w+", question.lower())
    a = re.findall(r"\w+", _LEAD.sub("", answer).lower())
    if len(a) < 4 or len(q) < 4 or len(set(a) & set(q)) < 0.7 * len(set(a)):
        return False
    return tiled(q, a) >= 0.85 * len(a) and len(a) >= 0.3 * len(q)


# Commonest function words of the languages that are written in Latin letters.
FUNCTION_WORDS = {
    "en": set("the a an and or of to in is it that for with as on at by this from be are was which not but has have now when after before than if how does do".split()),
    "de": set("der die das und oder von zu im in ist es dass für mit als auf an bei dieser aus sind war nicht aber hat habe nur wird wenn nach vor noch den dem des ein eine einen nie auch denn daher".split()),
    "es": set("el la los las y o de del en es que para con como por este esta desde ser son era no pero ha ahora cuando después antes si un una se más así porque lo al ya ni sin su".split()),
    "fr": set("le la les et ou de du des en est que pour avec comme par ce cette dans sont était ne pas mais a quand après avant si un une se plus au aux qui sur".split()),
}
#: Weight of a word: less the more languages have it, so that what tells them apart decides.
WORD_WEIGHTS = {w: 1 / sum(w in s for s in FUNCTION_WORDS.values()) ** 2 for s in FUNCTION_WORDS.values() for w in s}
_ASKS = re.compile(
    r"(?i)\b(?:in|into|auf|ins|en|al)\s+(?:english|german|korean|spanish|french|englisch\w*|deutsch\w*|koreanisch\w*|spanisch\w*|französisch\w*|inglés|alemán|coreano|español|francés)\b|(?:영어|독일어|한국어|스페인어|프랑스어)로|translat|übersetz|traduc|번역"
)


def language(text: str) -> str:
    """The language of the prose of ``text``: ``ko``, ``en``, ``de``, ``es``, ``fr`` or '' where it can't be told."""
    prose = re.sub(r"```.*?(?:```|$)", " ", text, flags=re.S)
    prose = re.sub(r"`[^`]*`|[\w.-]*[/_][\w./-]*|\b\w*[a-z][A-Z]\w*", " ", prose)
    letters = re.findall(r"[^\W\d_]+", prose.lower())
    hangul = sum(1 for w in letters if "가" <= w[0] <= "힣")
    if hangul >= 2 and hangul >= 0.4 * len(letters):
        return "ko"
    if len(letters) < 5:
        return ""
    known = [w for w in letters if w in WORD_WEIGHTS]
    hits = sorted(((sum(WORD_WEIGHTS[w] for w in known if w in s), k) for k, s in FUNCTION_WORDS.items()), reverse=True)
    if len(known) < 2 or len(known) < 0.1 * len(letters) or hits[0][0] < 0.8 or hits[0][0] <= 1.3 * hits[1][0]:
        return ""
    return hits[0][1]


def defect(question: str | None, answer: str | None) -> str | None:
    """The defect of a pair or None. A missing question or answer is ``empty``."""
    q, a = question or "", answer or ""
    bare = _INVISIBLE.sub(" ", re.sub(r"(?m)^\s*(?:```|~~~)\w*\s*$", "", a)).strip().strip("*_`").strip()
    if bare.lower() in STAND_INS or not _INVISIBLE.sub("", q):
        return "empty"
    if is_refusal(a):
        return "refusal"
    if is_copy(q, a):
        return "copy"
    ql, al = language(q), language(a)
    if ql and al and ql != al and not _ASKS.search(q):
        return "language"
    return "truncated" if breaks_off(a) else None


def flag_pairs(turns: DataFrame) -> DataFrame:
    """(turn_id, defect) of the defective pairs of ``turns`` (turn_id, question, answer); other columns are dropped.

    Re-delivered rows count once: identical results are merged, and of rows that differ the smallest defect counts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(i, d) for i, q, a in zip(b["turn_id"], b["question"], b["answer"], strict=True) if (d := defect(q, a))]
            yield pd.DataFrame(found, columns=["turn_id", "defect"])

    rows = turns.select(F.col("turn_id").cast("long").alias("turn_id"), "question", "answer").where("turn_id is not null")
    return rows.mapInPandas(run, "turn_id long, defect string").groupBy("turn_id").agg(F.min("defect").alias("defect"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(turn_id, defect) of every defective turn."""
    return flag_pairs(table(spark, sf_dir, "turns"))


QUERIES = {"p7_found": p7_found}
SQL: dict[str, str] = {}
