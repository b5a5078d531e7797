"""Hits as text: citations, blocks and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..operators.store import DOCUMENT


def citation() -> Column:
    """The source of a document, by type; a NULL time shows as ``?``. Dates are those of the session's zone."""
    when = F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("?"))
    col = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kind = F.col("source_type")
    tag = F.when(F.col("agent").isNotNull() & (F.col("agent") != "claude"), F.concat(F.lit("["), F.col("agent"), F.lit("] "))).otherwise(F.lit(""))
    session = F.coalesce(F.nullif("session_title", F.lit("")), F.col("title"), F.lit(""))
    return (
        F.when(kind == "agent_turn", F.concat(col("repo"), F.lit(" "), when, F.lit(" "), tag, F.lit("session:"), session))
        .when(kind == "code", F.concat(col("repo"), F.lit("/"), col("title")))
        .when(kind == "commit", F.concat(col("repo"), F.lit("@"), col("path"), F.lit(' "'), col("title"), F.lit('"')))
        .when(kind == "note", F.concat(F.lit("note "), when))
        .otherwise(F.coalesce(F.nullif("path", F.lit("")), F.lit("")))
    )


def cited(docs: DataFrame) -> DataFrame:
    """``docs`` with ``citation``; columns that a citation needs and ``docs`` lacks count as NULL."""
    for f in DOCUMENT:
        if f.name not in docs.columns:
            docs = docs.withColumn(f.name, F.lit(None).cast(f.dataType))
    return docs.withColumn("citation", citation())


def block() -> Column:
    """A hit (``cited``, with rank) as text: its citation, then question, summary and first commit of a turn, or the start of the text."""
    col = lambda c: F.coalesce(F.col(c), F.lit(""))
    first = F.get("commits", F.lit(0))
    turn = F.concat_ws(
        "\n",
        F.concat(F.lit("Q: "), F.coalesce(F.nullif("question", F.lit("")), F.col("title"), F.lit(""))),
        F.when(col("answer_summary") != "", F.concat(F.lit("A: "), F.col("answer_summary"))),
        F.when(first.isNotNull(), F.concat(F.lit("→ commit "), F.coalesce(first["hash"], F.lit("")), F.lit(": "), F.coalesce(first["subject"], F.lit("")))),
    )
    summed = F.col("source_type").isin("code", "commit") & (col("summary") != "")
    body = F.when(F.col("source_type") == "agent_turn", turn).when(summed, F.concat("summary", F.lit("\n"), F.substring(col("text"), 1, 300))).otherwise(F.substring(col("text"), 1, 400))
    return F.concat(F.lit("### ["), F.col("rank").cast("string"), F.lit("] "), F.col("citation"), F.lit("\n"), body)


def context(hits: list[Row]) -> str:
    """Numbered, cited texts for a prompt."""
    return "\n\n".join(f"[{n}] ({h['citation']})\n{h['text']}" for n, h in enumerate(hits, 1))
