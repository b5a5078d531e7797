"""Masking of secrets by precise patterns, as column expressions.

The rules run in a fixed order on the text that the earlier ones leave; the count adds the matches of each step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .instants import once
from .text import looks_secret

# Patterns and labels in the order they apply.
RULES = (
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "PRIVATE_KEY"),
    (r"AKIA[0-9A-Z]{16}", "AWS_ACCESS_KEY"),
    (r"ghp_[0-9A-Za-z]{36}", "GITHUB_TOKEN"),
    (r"gh[oprsu]_[0-9A-Za-z]{36,}", "GITHUB_TOKEN"),
    (r"xox[baprs]-[0-9A-Za-z-]{10,}", "SLACK_TOKEN"),
    (r"sk-[A-Za-z0-9]{20,}", "API_KEY"),
    (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "JWT"),
)
KEYWORDS = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|client[_-]?secret"
KEY_VALUE = rf"(?iU)\b({KEYWORDS})\b(\s*[=:]\s*)([\"']?)([^\s\"'«]{{6,}})\3"
CANDIDATE = r"[A-Za-z0-9+/=_-]{32,}"


def mask(label: str) -> str:
    """What a secret is replaced by; no rule matches it again."""
    return f"«REDACTED:{label}»"


def steps() -> list[tuple[str, str]]:
    """(pattern, replacement) of every rule in order."""
    return [(p, mask(label)) for p, label in RULES] + [(KEY_VALUE, "$1$2" + mask("SECRET"))]


def redact(c: Column, high_entropy: bool = False) -> Column:
    """The masked text."""
    for pattern, to in steps():
        c = F.regexp_replace(c, pattern, to)
    return mask_entropy(c) if high_entropy else c


def mask_entropy(c: Column) -> Column:
    """Masks every long token that looks secret. Longer tokens go first, so that one inside another isn't cut out of it."""
    return _without(c, _secret_looking(c))


def _secret_looking(c: Column) -> Column:
    found = F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(f"({CANDIDATE})")), looks_secret))
    return F.array_sort(found, lambda a, b: F.length(b) - F.length(a))


def _without(c: Column, tokens: Column) -> Column:
    return F.aggregate(tokens, c, lambda text, token: F.replace(text, token, F.lit(mask("HIGH_ENTROPY"))))


def redact_columns(df: DataFrame, columns: list[str], count: str = "n_masked", high_entropy: bool = False) -> DataFrame:
    """``df`` with ``columns`` masked and ``count``, the number of masks over all of them; NULLs stay and count 0. With
    ``high_entropy`` tokens that look secret are masked last.

    Each step is a stage of its own, so that a text is scanned twice per rule and no expression is nested.
    """
    df = df.withColumn(count, F.lit(0))
    for pattern, to in steps():
        hits = sum((F.coalesce(F.regexp_count(F.col(c), F.lit(pattern)), F.lit(0)) for c in columns), F.col(count))
        df = df.withColumns({**{c: F.regexp_replace(F.col(c), pattern, to) for c in columns}, count: hits})
    if high_entropy:
        for c in columns:  # the text and its tokens are stages of their own too
            df = once(df, c, F.col(c))
            df = once(df, "_tokens", _secret_looking(F.col(c)))
            df = df.withColumns({c: _without(F.col(c), F.col("_tokens")), "_before": F.col(c)})
            label = F.lit(mask("HIGH_ENTROPY"))
            more = F.coalesce(F.regexp_count(F.col(c), label) - F.regexp_count("_before", label), F.lit(0))
            df = df.withColumn(count, F.col(count) + more).drop("_tokens", "_before")
    return df
