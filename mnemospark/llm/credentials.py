"""Problem 1: credentials in source, configuration, notes and answers, found by segmentation and redacted in place.

A literal is segmented by Viterbi into words of a dictionary counted over all texts. The letters that no word covers,
the digits and the marks that join no words are its residual. Long residuals are secrets wherever they stand, shorter
ones only in a context: an assignment, argument, header, command or connection string whose key names a secret, or a
sentence with such a noun near the literal. Known formats of hashes, ids and public keys are excluded, and so are
references, calls and masks. A word alone that a key calls a password is a weak password, unless it is a placeholder.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: Most words the dictionary holds, by document frequency; a bound of the model, so that it can be sent to all tasks.
DICTIONARY_WORDS = 30_000
#: Least share of the distinct texts that hold a word, and their least number, which only counts in small corpora.
WORD_SHARE, WORD_TEXTS = 0.0001, 5
#: Residuals from which a literal is a secret without any context and in one.
LONG_RESIDUAL, NAMED_RESIDUAL = 14, 3
#: Characters before and after a literal in which a sentence must name a secret.
BEFORE, AFTER = 60, 30

# Name parts that make the value a secret, and those that take that back.
_STEM = (
    r"pass(?:word|wd|phrase|wort)?|passwd|pwd|pw|secrets?|token|api[_\- ]?key|auth|credentials?|conn(?:ection)?[_-]?string"
    r"|(?:access|signing|deploy|private|secret|salt|encryption|master|session|storage|account|shared|service)(?:[_\-]\w+)?[_\-]?key"
    r"|key[_-]?data|signing[_-]?cert|contraseña|clave|암호|비밀번호|kennwort|토큰"
)
_NOT_KEY = re.compile(r"(?i)count|limit|length|size|ttl|expir|url|uri|endpoint|path|file|policy|hash|sha\d|digest|integrity|public|(?:^|[_-])id$|request|name$|type$|author")
_STEM_KEY = re.compile(rf"(?i)(?:^|[^a-z])(?:{_STEM})(?:$|[^a-z])|(?:{_STEM})$|(?<=[a-z])(?:Password|Secret|Token|Key|Pass|Auth)")
_PLACEHOLDER = re.compile(
    r"(?i)^(?:change[_-]?(?:me|it)|dummy|example|sample|todo|tbd|fixme|none|null|nil|true|false|yes|no|n/?a|redacted|removed|hidden|masked|placeholder|password|passwd|secret|token"
    r"|test|default|empty|undefined|required|optional|string|str|your[\w-]*|my[_-]?(?:secret|password|token)|x{3,}|\*+|\.{2,}|-+|•+|_+|0+|<[^>]*>|\[[^\]]*\]|insert[\w-]*|replace[\w-]*|enter[\w-]*)$"
)
_REFERENCE = re.compile(
    r"^\$|^%\w+%$|\$\{|\{\{|^<.*>$|«|»|^process\.env|^os\.|^env[.\[(]|^System\.|^getenv|^ENV\[|^secrets?\.|^vault:|^config\.|^settings\.|^self\.|^this\.|^args\.|\w\(|^!(?:vault|ref|secret|env|include|sub)\b|^arn:|^ref\+|^@|^data:|^file:"
)
_URL = re.compile(r"^[a-z][a-z0-9+.-]*://", re.I)
_HEX = re.compile(r"^(?:0x)?[0-9a-f]+$|^[0-9A-F]+$")
_HASHED = re.compile(r"^(?:sha\d+[-:]|md5[-:]|\$2[aby]\$|\$argon2|\{SSHA\})", re.I)
_UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)

_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----(.*?)-----END \1-----", re.S)
_USERINFO = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@'\"`]*:([^\s/@'\"`]+)@")
_SCHEME = re.compile(r"(?i)\b(bearer|basic|token|apikey|api-key)[ :]+[`'\"]?([^\s\"'`,;<>]+)")
_VALUE = r"(?:\"((?:\\.|[^\"\\\n])*)\"|'((?:\\.|[^'\\\n])*)'|`([^`\n]*)`|([^\s\"'`,;)\]}]\S*))"
_TYPED = r"(?:\s*:\s*[A-Z]\w*(?:<\w+>)?\??\s*=\s*|\s*:=\s*|\s*=>\s*|\s*={1,3}\s*|\s*:\s*)"
_ASSIGNED = re.compile(rf"([\w.$-]*[\w$])([\"'`]?)(\]?){_TYPED}{_VALUE}")
_ARGUMENT = re.compile(rf"[\"'`]([\w.-]+)[\"'`]\s*,\s*{_VALUE}")
_FLAG = re.compile(rf"(?:^|\s)--?([A-Za-z][\w-]+)\s+{_VALUE}")
_PAIR = re.compile(rf"-?\s*[\"']?name[\"']?\s*[:=]\s*[\"']?([\w.-]+)[\"']?\s*,?\s*\n\s*[\"']?value[\"']?\s*[:=]\s*{_VALUE}")
_TUPLE = re.compile(rf"([\w.$-]+)\s*=\s*\(\s*[\"'][^\"'\n]*[\"']\s*,\s*{_VALUE}\s*\)")
_TAG = re.compile(r"<([\w.:-]+)>([^<>\s]+)</\1>")
_COMMAND = re.compile(
    rf"(?:IDENTIFIED\s+BY|WITH\s+PASSWORD|\bPASSWORD)\s+{_VALUE}|\bpassword\s+(\S+)\s*$|\bsshpass\s+-p\s*{_VALUE}|\bmysql\b[^\n]*?\s-p(\S+)|\bcurl\b[^\n]*?\s-u\s*[\"']?[^\s:\"']+:([^\s\"']+)", re.I
)
# Nouns and verbs of sentences that give a secret away; a literal is near one or is none.
_NOUN = re.compile(
    rf"(?i)(?<![a-z_/-])(?:{_STEM}|keys?|passcode|pin|log ?in|sign ?in|login|schlüssel|zugang|zugangsdaten|anmeld\w*|acceso|inicia\w* sesión|credenciales?|로그인|열쇠|접속)(?![a-z_/-])"
)
_QUOTED = re.compile(r"\"([^\"\s]+)\"|'([^'\s]+)'|`([^`\s]+)`|(?<![^\s(\[])([^\s\"'`()\[\]{}<>]+)")
_KEY_PLACE = re.compile(r"\s*\]?\s*(?::|=(?!=))")
_SENTENCE_END = re.compile(r"[.!?:;] ")
# One of these is in every line that names a secret; case-folded texts are searched.
_LINE_KEYS = re.compile(r"pass|pwd|[_-]pw|secret|token|key|auth|credential|credencial|conn|cert|contraseña|clave|암호|비밀번호|kennwort|토큰|identified|mysql|curl|\bpin\b|\bpw\b|log ?in|sign ?in|schlüssel|zugang|anmeld|acceso|sesión|로그인|열쇠|접속")
_BARE = re.compile(r"(?<![\w/+.~-])[A-Za-z0-9+/=_~.\-]{16,}")
_DIGIT = re.compile(r"\d")
_KNOWN = re.compile(
    r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[oprsu]_[0-9A-Za-z]{30,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abeprs]-[0-9A-Za-z-]{10,}|sk-[\w-]{20,}|[sr]k_(?:live|test)_\w{16,}|npm_[0-9A-Za-z]{30,}|pypi-[\w-]{16,}"
    r"|AIza[\w-]{30,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}|SG\.[\w-]{16,}\.[\w-]{16,}|hf_[A-Za-z]{30,}|dop_v1_[0-9a-f]{40,}|pk[0-9a-z]{5,7}\.[A-Za-z0-9]{24,})$"
)
_EXCLUDED = re.compile(
    r"sha\d{1,3}-[A-Za-z0-9+/=]+|ssh-[\w-]+ [A-Za-z0-9+/=]+|ecdsa-\S+ [A-Za-z0-9+/=]+|data:[\w/+.-]+;base64,[A-Za-z0-9+/=]*|-----BEGIN (?:PUBLIC KEY|CERTIFICATE|RSA PUBLIC KEY)-----.*?-----END [A-Z ]+-----|[a-z][a-z0-9+.-]*://\S+", re.S
)
_TRAILING = ".,;:?)]}'\"`>"
# A literal with a letter after a digit, from its first character on; possessive, so that long runs are read once.
_MIXED = r"(?<![^\s\"'`()<>\[\]{},;])[^\s\"'`()<>\[\]{},;0-9]*+[0-9][^\s\"'`()<>\[\]{},;A-Za-z]*+[A-Za-z][^\s\"'`()<>\[\]{},;]*+"


class Words:
    """A unigram word model; ``residual`` segments a literal and counts the characters that no word explains."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=0)
        self.seen: dict[str, tuple[int, int]] = {}

    def residual(self, literal: str) -> tuple[int, int]:
        """(letters and digits that no word explains, number of words); up to five digits after a word are its number."""
        if literal in self.seen:
            return self.seen[literal]
        left = words = 0
        for run in re.findall(r"[A-Za-z]+|[0-9]+", literal):
            if run[0].isdigit():
                left += 0 if len(run) <= 5 and words else len(run)
                continue
            a, n = self._run(run.lower(), [k for k in range(1, len(run)) if run[k].isupper() and run[k - 1].islower()])
            left, words = left + a, words + n
        if len(self.seen) > 50_000:
            self.seen.clear()
        self.seen[literal] = left, words
        return left, words

    def _run(self, s: str, humps: list[int]) -> tuple[int, int]:
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
        for end in range(1, len(s) + 1):
            cost, left, words = best[end - 1]
            top = (cost + 9.0, left + 1, words)
            for start in range(max(0, end - self.longest), end - 2):
                w = self.cost.get(s[start:end])
                if w is not None and best[start][0] + w < top[0]:
                    top = (best[start][0] + w, best[start][1], best[start][2] + 1)
            best.append(top)
        return best[-1][1], best[-1][2]


def _first(groups: tuple) -> tuple[str, bool]:
    """The matched alternative of _VALUE and whether it stood in quotes."""
    quoted = next((g for g in groups[:3] if g is not None), None)
    return (quoted, True) if quoted is not None else ((groups[3] or ""), False)


def _bare_value(v: str) -> str:
    v = re.split(r"[;,](?=[A-Za-z ]+=|$|\s)", v)[0] if ";" in v or "," in v else v
    return v.rstrip(_TRAILING) if not v.endswith("=") else v


def surprise(v: str, words: Words) -> int:
    """The residual of a literal in a context: letters that no word covers, digits, marks that don't join words, and one
    for words joined in no style of names (``Word-word``)."""
    left, _ = words.residual(re.sub(r"\d", "", v))
    return left + len(_DIGIT.findall(v)) + len(re.findall(r"[^\w.\-/: ]", v)) + bool(re.search(r"[A-Z][a-z]+[-_][a-z]", v))


def _is_secret(v: str, quoted: bool, words: Words, named: str) -> bool:
    """Whether a literal in a context that names a secret is one. ``named``: the key, '' in sentences and commands."""
    if len(v) < 4 or " " in v.strip() or "\\n" in v or _PLACEHOLDER.match(v) or _REFERENCE.search(v) or _URL.match(v) or _HASHED.match(v) or _UUID.match(v):
        return False
    if v.startswith(("ssh-", "/", "./", "-----")) or re.fullmatch(r"[\w./-]+\.[a-z]{2,4}", v):
        return False
    if _KNOWN.match(v):
        return True
    if re.fullmatch(r"[\d.,:]+", v):  # a number is a secret only where it is called so
        return quoted and bool(re.search(r"(?i)pass|pwd|pin|pw$", named))
    if re.fullmatch(r"[a-z]+", v) and quoted and re.search(r"(?i)pass|pwd|pw$", named) and words.residual(v) == (0, 1):
        return True  # a weak password
    if not quoted and re.fullmatch(r"[A-Za-z_.\-\[\]]+", v):  # may be a name: most of it must be unexplained
        return words.residual(v)[0] >= max(8, len(v) / 2)
    return surprise(v, words) >= NAMED_RESIDUAL


def find_secrets(text: str | None, words: Words) -> list[str]:
    """The distinct secrets of ``text`` exactly as they stand, in order; [] for None and blank text."""
    if not text or text.isspace():
        return []
    found: dict[str, None] = {}
    for m in _PEM.finditer(text):
        if len(re.findall(r"[A-Za-z0-9+/=]{16,}", m[2])) >= 1:
            found[m[0]] = None
    body = _PEM.sub(" ", text) if found else text
    if "://" in body:
        for m in _USERINFO.finditer(body):
            v = m[1]
            if not _PLACEHOLDER.match(v) and not _REFERENCE.search(v) and not re.fullmatch(r"\d{1,5}", v):
                found[v] = None
    body = _EXCLUDED.sub(" ", body)
    if "name" in body:
        for m in _PAIR.finditer(body):
            v, q = _first(m.groups()[1:5])
            v = v if q else _bare_value(v)
            if _named(m[1]) and _is_secret(v, q, words, m[1]):
                found[v] = None
    end = -1
    for m in _LINE_KEYS.finditer(body.lower() if len(body.lower()) == len(body) else body):
        if m.start() >= end:
            start, end = body.rfind("\n", 0, m.start()) + 1, body.find("\n", m.start())
            end = end if end >= 0 else len(body)
            _in_line(body[start:end], words, found)
    for m in _BARE.finditer(body):
        if _DIGIT.search(m[0]):
            start = body.rfind("\n", 0, m.start()) + 1
            _bare(body[max(start, m.start() - 40) : m.start()], m[0], words, found)
    return list(found)


def _named(key: str) -> bool:
    return bool(_STEM_KEY.search(key)) and not _NOT_KEY.search(key)


def _in_line(line: str, words: Words, found: dict[str, None]) -> None:
    for m in _SCHEME.finditer(line):
        v = m[2].rstrip(".,;)")
        if m[1].lower() == "basic":
            try:
                plain = base64.b64decode(v + "=" * (-len(v) % 4), validate=True)
            except (binascii.Error, ValueError):
                continue
            if b":" in plain and not _PLACEHOLDER.match(plain.split(b":", 1)[1].decode("utf-8", "replace") or "x"):
                found[v] = None
        elif "uthorization" in line[max(0, m.start() - 40) : m.start()] and _is_secret(v, True, words, "token"):
            found[v] = None
    named = "uthorization" in line
    for pattern in (_ASSIGNED, _ARGUMENT, _FLAG, _TUPLE):
        pos = 0
        while m := pattern.search(line, pos):
            pos = m.start(1) + len(m[1])
            key = m[1]
            v, q = _first(m.groups()[-4:])
            if named and "uthorization" in key or not _named(key):
                continue
            v = v if q else _bare_value(v)
            q = q or line[m.start(1) - 1 : m.start(1)] == ";"  # a part of a connection string is a literal
            if _is_secret(v, q, words, key) and (pattern is not _FLAG or q or not v.startswith("-")):
                found[v] = None
    for m in _TAG.finditer(line):
        if _named(m[1]) and _is_secret(m[2], True, words, m[1]):
            found[m[2]] = None
    refused = set()
    for m in _COMMAND.finditer(line):
        g = m.groups()
        v, q = next((x for x in (_first(g[0:4]), (g[4] or "", True), _first(g[5:9]), (g[9] or "", True), (g[10] or "", True)) if x[0]), ("", False))
        v = v.rstrip(".,;") if not q else v
        if len(v) == 64 and _HEX.match(v):  # a digest, as no key says otherwise
            refused.add(v)
        elif _is_secret(v, q, words, ""):
            found[v] = None
    nouns = list(_NOUN.finditer(line))
    if nouns:
        literals = list(_QUOTED.finditer(line))
        ends = [m.end() for m in literals]
        for noun in nouns:
            for m in literals[bisect_left(ends, noun.start() - AFTER) :]:
                if m.start() >= noun.end() + BEFORE:
                    break
                v, q = _first(m.groups())
                v = v if q else v.rstrip(_TRAILING)
                if v not in refused and not (q and _is_key(line, m)) and _same_sentence(line, noun, m) and _told(v, q) and _is_secret(v, True, words, ""):
                    found[v] = None


def _is_key(line: str, literal: re.Match) -> bool:
    """Whether a quoted literal is a key: before an assignment or colon, in a subscript, or the name of an environment variable."""
    return bool(_KEY_PLACE.match(line, literal.end()) or re.search(r"(?i)\w\[$|env\w*\($", line[max(0, literal.start() - 20) : literal.start()]))


def _same_sentence(line: str, noun: re.Match, literal: re.Match) -> bool:
    if literal.start() >= noun.end():
        gap = line[noun.end() : literal.start()]
    elif literal.end() <= noun.start():
        gap = line[literal.end() : noun.start()]
    else:
        return False
    return not _SENTENCE_END.search(gap) or bool(re.fullmatch(r"\s*[^\w\s]*:\s*", gap))


def _told(v: str, quoted: bool) -> bool:
    """Whether a literal of a sentence may be a value: quoted, or letters with digits, and no assignment."""
    return bool(re.search(r"[A-Za-z0-9]", v) and "=" not in v[:-2] and (quoted or re.search(r"\d", v) and re.search(r"[^\W\d]", v)))


def _bare(before: str, literal: str, words: Words, found: dict[str, None]) -> None:
    v = literal.rstrip(".-")
    if "=" in v[:-2] and not v.endswith("="):  # key=value without blanks: judged as an assignment
        v = v.rsplit("=", 1)[1]
        key = literal.split("=", 1)[0]
        if _NOT_KEY.search(key.lstrip("-")) and not _STEM_KEY.search(key):
            return
    elif (k := re.search(r"([\w-]+)[\"'`]?\]?\s*(?::=|[:=,]|\s)\s*[\"'`]?$", before)) and _NOT_KEY.search(k[1]):
        return
    if _KNOWN.match(v):
        found[v] = None
        return
    if len(v) < 20 or v in found or any(v in x for x in found) or _HEX.match(v) or _UUID.match(v) or "/" in v and re.search(r"\.\w{1,5}$", v):
        return
    if re.search(r"(?i)basic\s*$", before) or not (re.search(r"\d", v) and re.search(r"[A-Z]", v) and re.search(r"[a-z]", v)):
        return
    if words.residual(v)[0] >= LONG_RESIDUAL and len(v) >= 24:
        found[v] = None


def dictionary(texts: DataFrame, column: str = "text") -> dict[str, int]:
    """The commonest word parts of all texts with the number of distinct texts that hold them, at most DICTIONARY_WORDS.

    A word stands in a share of the texts, so that random fragments don't become words as a corpus grows. Literals with
    letters after digits are left out, as they are what the words are to judge, and copies count once.
    """
    plain = F.regexp_replace(F.col(column), F.lit(_MIXED), F.lit(" "))
    parts = F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(r"([A-Z]?[a-z]{2,14}|[A-Z]{3,14})")), F.lower))
    marked = F.concat(F.array(F.lit("")), F.filter(parts, lambda w: F.length(w) >= 3))  # the blank word counts the texts
    once = texts.where(F.col(column).isNotNull()).groupBy(F.md5(F.col(column).cast("binary")).alias("h")).agg(F.first(marked).alias("parts"))
    counts = once.select(F.explode("parts").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= WORD_TEXTS)
    rows = counts.orderBy(F.col("w") != "", F.desc("n"), "w").limit(DICTIONARY_WORDS + 1).collect()
    return {r["w"]: r["n"] for r in rows[1:] if r["n"] >= WORD_SHARE * rows[0]["n"]}


def extract(texts: DataFrame, counts: dict[str, int]) -> DataFrame:
    """(src, row_id, secret) of every secret in ``texts`` (src, row_id, text); NULL and blank texts give no row."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(shared.value)
        for b in batches:
            rows = [(s, i, v) for s, i, t in zip(b["src"], b["row_id"], b["text"], strict=True) for v in find_secrets(t, words)]
            yield pd.DataFrame(rows, columns=["src", "row_id", "secret"])

    wanted = texts.select("src", F.col("row_id").cast("long").alias("row_id"), "text").where("row_id is not null and text is not null")
    return wanted.mapInPandas(run, "src string, row_id long, secret string").distinct()


def masked(text: str | None, secrets: list[str]) -> tuple[str | None, int]:
    """``text`` with a label for every secret that stands alone, and the number of labels. An occurrence inside a longer
    word or number is part of another literal and stays; of overlapping secrets the longest is replaced."""
    if not secrets:
        return text, 0
    word = r"[A-Za-z0-9_]"
    alone = (rf"(?<!{word}){re.escape(v)}(?!{word})" for v in sorted(secrets, key=len, reverse=True))
    return re.subn("|".join(alone), lambda m: "«REDACTED:PRIVATE_KEY»" if m[0].startswith("-----BEGIN") else "«REDACTED:SECRET»", text)


def redact(texts: DataFrame, counts: dict[str, int]) -> DataFrame:
    """``texts`` (src, row_id, text, ...) with ``masked``, where every secret is replaced by a mask that keeps the code
    around it, quotes and lines included, and ``n_masked``. NULL text stays NULL with 0."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    @F.pandas_udf("masked string, n_masked int")
    def mask(col: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = Words(shared.value)
        for s in col:
            out = []
            for t in s:
                t, n = masked(t, find_secrets(t, words))
                out.append((t, n))
            yield pd.DataFrame(out, columns=["masked", "n_masked"])

    kept = [c for c in texts.columns if c not in ("masked", "n_masked")]
    return texts.withColumn("_m", mask(F.col("text"))).select(*kept, "_m.masked", "_m.n_masked")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("row_id"), "text")
    turns = table(spark, sf_dir, "turns").select(F.lit("turn").alias("src"), F.col("turn_id").alias("row_id"), F.col("answer").alias("text"))
    return docs.unionAll(turns)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_id, secret) of all documents and answers."""
    texts = _texts(spark, sf_dir)
    return extract(texts, dictionary(texts))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_id, n_masked, n_chars) of every masked document and answer; re-delivered turns count once."""
    texts = _texts(spark, sf_dir)
    out = redact(texts, dictionary(texts)).where("n_masked > 0")
    return out.select("src", "row_id", "n_masked", F.length("masked").alias("n_chars")).distinct()


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted}
SQL: dict[str, str] = {}
