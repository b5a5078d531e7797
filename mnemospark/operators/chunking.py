"""Source files cut into line-ranged chunks: sliding windows and declaration boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instants import once
from ..functions.text import is_indexable, language_of, lines, make_id

WINDOW, OVERLAP, MAX_UNIT = 60, 15, 120

# What a declaration looks like, by language.
PYTHON_DECLARATION = r"^\s*(?:async\s+)?(?:def|class)\s+\w"
BRACE_DECLARATION = r"^\s*(?:[\w@<>\[\]]+\s+){0,5}(?:fun|func|fn|class|interface|object|enum|struct|impl|trait)\s+\w"
BRACE_LANGUAGES = ("kotlin", "java", "javascript", "typescript", "go", "rust", "c", "cpp", "gradle")


def window_starts(n: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """0-based first lines of the windows over ``n`` lines; the last window reaches the end, none for no lines."""
    step = max(1, window - overlap)
    last = F.greatest(F.lit(0), F.ceil((n - window) / F.lit(float(step))).cast("int") * step)
    return F.when(n > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def declaration_starts(ls: Column, language: Column) -> Column:
    """0-based lines on which a declaration starts; none in languages without a pattern."""
    numbered = F.transform(ls, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    hit = lambda p: F.transform(F.filter(numbered, lambda r: r["x"].rlike("(?U)" + p)), lambda r: r["i"])
    none = F.array().cast("array<int>")
    return F.when(language == "python", hit(PYTHON_DECLARATION)).when(language.isin(*BRACE_LANGUAGES), hit(BRACE_DECLARATION)).otherwise(none)


def _bounds(n: Column, cuts: Column) -> Column:
    """[(a, b)] 0-based, b exclusive: the segments between neighbouring ``cuts`` (0, declarations, n), over-long ones and
    files without declarations cut into windows."""

    def windows(a: Column, b: Column) -> Column:
        return F.transform(window_starts(b - a), lambda s: F.struct((a + s).alias("a"), F.least(a + s + WINDOW, b).alias("b")))

    segments = F.transform(F.arrays_zip(F.slice(cuts, F.lit(1), F.size(cuts) - 1).alias("a"), F.slice(cuts, F.lit(2), F.size(cuts) - 1).alias("b")), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b")))
    cut_up = F.flatten(
        F.transform(segments, lambda s: F.when(s["b"] - s["a"] > MAX_UNIT, windows(s["a"], s["b"])).otherwise(F.array(s)))
    )
    return F.when(n == 0, F.array().cast("array<struct<a:int,b:int>>")).otherwise(cut_up)


def chunk_lines(files: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """``files`` (text, ...) as one row per window with start_line, end_line (1-based, inclusive) and chunk.

    NULL and empty texts give no row; ``text`` is dropped, columns of the new names are replaced.
    """
    ls = F.col("_lines")
    f = files.withColumn("_lines", lines(F.col("text"))).withColumn("_at", F.explode(window_starts(F.size(ls), window, overlap)))
    end = F.least(F.col("_at") + window, F.size(ls))
    return f.withColumns(
        {"start_line": F.col("_at") + 1, "end_line": end, "chunk": F.array_join(F.slice(ls, F.col("_at") + 1, end - F.col("_at")), "\n")}
    ).drop("_lines", "_at", "text")


def chunk_symbols(files: DataFrame, language: str = "lang") -> DataFrame:
    """As ``chunk_lines``, cut at the declarations of the language in column ``language`` (NULL: windows).

    Lines and cuts are computed once for each file, so that the work grows with its length. A file without
    declarations is one segment in windows of any length; with them only segments over MAX_UNIT lines are cut up.
    """
    ls, n = F.col("_lines"), F.size("_lines")
    f = once(files, "_lines", lines(F.col("text")))
    f = once(f, "_starts", declaration_starts(ls, F.coalesce(F.col(language), F.lit(""))))
    f = once(f, "_cuts", F.array_distinct(F.concat(F.array(F.lit(0)), F.col("_starts"), F.array(n))))
    plain = F.transform(window_starts(n), lambda s: F.struct(s.alias("a"), F.least(s + WINDOW, n).alias("b")))
    f = f.withColumn("_b", F.explode(F.when(F.size("_starts") == 0, plain).otherwise(_bounds(n, F.col("_cuts")))))
    a, b = F.col("_b.a"), F.col("_b.b")
    return f.withColumns({"start_line": a + 1, "end_line": b, "chunk": F.array_join(F.slice(ls, a + 1, b - a), "\n")}).drop("_lines", "_starts", "_cuts", "_b", "text")


def code_documents(files: DataFrame) -> DataFrame:
    """Code documents (id, source_type, repo, path, title, text, lang, start_line, end_line) of files (repo, path, text).

    Blank chunks and files that are not indexable by ending, size or a NUL byte are left out.
    """
    size = F.octet_length(F.col("text"))
    f = files.where(is_indexable(F.col("path"), size, F.col("text"))).withColumn("lang", language_of(F.col("path")))
    c = chunk_symbols(f.select("repo", "path", "text", "lang")).where(F.col("chunk").rlike(r"(?U)\S"))
    title = F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return c.select(
        make_id("code", F.col("repo"), F.col("path"), F.col("start_line")).alias("id"), F.lit("code").alias("source_type"),
        "repo", "path", title.alias("title"), F.col("chunk").alias("text"), "lang", "start_line", "end_line",
    )
