"""Column functions over text: stripping, lines, identities, summaries, tokens and small predicates.

All are JVM expressions. NULL in gives NULL out unless said otherwise.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line terminators, injected blocks, file endings and languages, path-like argument keys.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
INJECTED_TAGS = ("system-reminder", "task-notification")
SKIPPED_ENDINGS = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".pdf", ".zip", ".gz",
    ".tar", ".jar", ".class", ".so", ".dylib", ".dll", ".bin", ".lock", ".woff",
    ".woff2", ".ttf", ".eot", ".mp4", ".mov", ".mp3", ".svg",
)
LANGUAGES = {
    ".py": "python", ".kt": "kotlin", ".java": "java", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".go": "go", ".rs": "rust", ".rb": "ruby", ".c": "c", ".h": "c", ".cpp": "cpp", ".sh": "shell", ".yaml": "yaml",
    ".yml": "yaml", ".toml": "toml", ".md": "markdown", ".sql": "sql", ".gradle": "gradle", ".kts": "kotlin",
}
PATH_KEYS = ("path", "file_path", "filename", "notebook_path", "dir_path", "absolute_path")
MAX_BYTES = 400_000
SUMMARY_CHARS = 130

TOKEN = r"[\p{L}\p{N}\p{Co}]+"
WORD = r"(?U)\w+"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def lines(c: Column) -> Column:
    """The lines of a text as an array, without an empty last one; no lines for an empty text."""
    body = F.regexp_replace(c, rf"(?:{LINE_BREAK})\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_BREAK, -1))


def make_id(kind: str | Column, *parts: Column) -> Column:
    """``kind:`` and 16 hex digits that depend on the kind and all parts; a NULL part counts as ``None``."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    joined = F.concat_ws("\u0000", k, *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(k, F.lit(":"), F.substring(F.sha1(joined.cast("binary")), 1, 16))


def clean_blocks(c: Column) -> Column:
    """Without the injected blocks, stripped."""
    for tag in INJECTED_TAGS:
        c = F.regexp_replace(c, rf"(?s)<{tag}>.*?</{tag}>", "")
    return strip(c)


def basename(c: Column) -> Column:
    """The last component of a path; of one that ends in slashes the one before them."""
    return F.regexp_extract(F.regexp_replace(c, "/+$", ""), r"[^/]*$", 0)


def repo_of(cwd: Column) -> Column:
    """The repository name of a working directory, ``(unknown)`` where there is none."""
    return F.when(F.coalesce(cwd, F.lit("")) == "", F.lit("(unknown)")).otherwise(basename(cwd))


def ending(path: Column) -> Column:
    """The lower-case file ending with its dot, '' if there is none; dot-files have none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))


def language_of(path: Column) -> Column:
    """The language of a path by its ending, ``text`` if it isn't known."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, ending(path)), F.lit("text"))


def is_indexable(path: Column, size: Column, content: Column | None = None) -> Column:
    """Whether a file is text of an allowed size by ending, size and, if given, the first 8192 bytes of ``content``."""
    ok = ~ending(path).isin(*SKIPPED_ENDINGS) & (size <= MAX_BYTES)
    return ok if content is None else ok & ~F.hex(F.substring(content.cast("binary"), 1, 8192)).rlike("^(..)*00")


def summarize(answer: Column, chars: int = SUMMARY_CHARS) -> Column:
    """The first sentence of more than eight characters, else the whole, cut to ``chars`` with an ellipsis; '' for none."""
    text = strip(F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?U)\s+", " "))
    parts = F.split(text, r"(?<=[.!?。])\s+|(?<=[다요죠음])\s+", -1)
    first = F.coalesce(F.get(F.filter(parts, lambda p: F.length(F.trim(p)) > 8), F.lit(0)), text)
    return F.when(F.length(first) <= chars, first).otherwise(F.concat(F.substring(first, 1, chars - 1), F.lit("…")))


def first_line(c: Column, chars: int = 80) -> Column:
    """The first line, cut to ``chars``; '' for an empty text."""
    return F.substring(F.coalesce(F.get(lines(c), F.lit(0)), F.lit("")), 1, chars)


def turn_title(session_title: Column, question: Column) -> Column:
    """The session's title or, where it is NULL or empty, the question's first line."""
    return F.when(F.coalesce(session_title, F.lit("")) != "", session_title).otherwise(first_line(F.coalesce(question, F.lit(""))))


@cache
def folding() -> tuple[str, str]:
    """(letters, their bases): letters below U+2000 that decompose into a base and one combining mark."""
    pairs = []
    for cp in range(0xC0, 0x2000):
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) == 2 and unicodedata.category(d[1]) == "Mn" and chr(cp).lower() == chr(cp):
            pairs.append((chr(cp), d[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Lower case, letters without their single mark; only texts that have letters beyond ASCII are translated."""
    low = F.lower(c)
    return F.when(low.rlike("[\u00c0-\u1fff]"), F.translate(low, *folding())).otherwise(low)


def index_tokens(c: Column) -> Column:
    """The index tokens of a text in order: runs of letters and digits, folded; none for NULL."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    """The number of index tokens of a text; folding changes letters, not their number of runs."""
    return F.regexp_count(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN))


def word_set(c: Column) -> Column:
    """The distinct lower-case words of a text; none for NULL."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays as sets, 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def entropy(c: Column) -> Column:
    """Shannon entropy in bits per character, 0 for an empty text."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.length(c)
    each = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
    return F.when(n == 0, 0.0).otherwise(F.aggregate(each, F.lit(0.0), lambda s, p: s - p * F.log2(p)))


def looks_secret(c: Column) -> Column:
    """Whether a token mixes upper case, lower case and digits and has more than four bits per character."""
    return c.rlike(r"\p{Lu}") & c.rlike(r"\p{Ll}") & c.rlike(r"\p{Nd}") & (entropy(c) > 4.0)


def has_work(kind: Column, files: Column, commits: Column) -> Column:
    """Whether a document is work: anything but a turn, or a turn with files or a commit linked by file."""
    by_file = F.exists(commits, lambda x: x["kind"] == "file")
    return (kind != "agent_turn") | (F.coalesce(F.size(files), F.lit(0)) > 0) | F.coalesce(by_file, F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of equal length; a norm of zero counts as one."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b))


def norm(a: Column) -> Column:
    n = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(n == 0, 1.0).otherwise(n)
