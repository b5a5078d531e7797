"""Agent session records as turns: a question, the answer collected after it, and what tools touched.

Records are rows (session_id, line, agent, type, content, ...) in line order. A real question opens a turn;
assistant text, tools and paths up to the next question belong to it; what comes before the first is dropped. Each
agent only differs in how a record is read, so the three readers give the same columns and share one assembly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PATH_KEYS, clean_blocks, repo_of, strip, summarize

# What user texts start with that are no questions, by agent.
NOISE = {
    "claude": (
        "<command-name>", "<command-message>", "<local-command-stdout>", "<bash-stdout>", "<bash-input>", "Caveat:",
        "<task-notification>", "This session is being continued from a previous conversation",
    ),
    "codex": ("<environment_context>", "<user_instructions>"),
    "gemini": ("<session_context>", "<environment_context>"),
}


def _starts(c: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _blocks(v: Column, path: str = "$") -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _joined(blocks: Column) -> Column:
    texts = F.filter(F.transform(blocks, lambda b: _get(b, "$.text")), lambda t: t != "")
    return strip(F.array_join(texts, "\n"))


def paths_of(args: Column) -> Column:
    """The path-like values of a tool call's arguments (a variant), in the order of the keys; strings only."""
    is_text = lambda k: F.schema_of_variant(F.try_variant_get(args, f"$.{k}", "variant")) == "STRING"
    return F.filter(F.array(*[F.when(is_text(k), _get(args, f"$.{k}")) for k in PATH_KEYS]), lambda p: p.isNotNull())



def _none() -> Column:
    return F.array().cast("array<string>")


def read_claude(records: DataFrame) -> DataFrame:
    """Question, text, tools, paths and title of claude records; content is plain text or a list of blocks."""
    kind, content = F.col("type"), F.col("content")
    is_list = content.startswith("[{") | (content == "[]")
    flagged = F.coalesce(F.col("is_meta"), F.lit(False)) | F.coalesce(F.col("is_sidechain"), F.lit(False))
    start = F.regexp_replace(content, r"(?U)\A\s+", "")
    asks = (kind == "user") & ~flagged & ~is_list & (start != "") & ~_starts(start, NOISE["claude"])
    r = records.withColumn("_v", F.when(is_list & (kind == "assistant"), F.try_parse_json(content)))
    blocks = _blocks(F.col("_v"))
    used = F.filter(blocks, lambda b: _get(b, "$.type") == "tool_use")
    path = lambda b: F.coalesce(*[F.nullif(_get(b, f"$.input.{k}"), F.lit("")) for k in ("file_path", "path", "notebook_path")])
    return r.select(
        *records.columns,
        F.coalesce(asks, F.lit(False)).alias("asks"),
        F.when(asks, clean_blocks(content)).otherwise(_joined(F.filter(blocks, lambda b: _get(b, "$.type") == "text"))).alias("said"),
        F.transform(used, lambda b: F.coalesce(_get(b, "$.name"), F.lit("?"))).alias("used"),
        F.filter(F.transform(used, path), lambda p: p.isNotNull()).alias("touched"),
        F.when(kind == "ai-title", F.nullif(content, F.lit(""))).alias("titled"),
    )


def read_codex(records: DataFrame) -> DataFrame:
    """The same of codex records: ``response_item`` payloads; messages of other roles and other records say nothing."""
    r = records.withColumn("_v", F.when(F.col("type") == "response_item", F.try_parse_json("content")))
    v = F.col("_v")
    kind, role = _get(v, "$.type"), _get(v, "$.role")
    text = F.when(kind == "message", _joined(_blocks(v, "$.content")))
    question = clean_blocks(text)
    asks = (role == "user") & (question != "") & ~_starts(question, NOISE["codex"])
    call = kind == "function_call"
    return r.select(
        *records.columns,
        F.coalesce(asks, F.lit(False)).alias("asks"),
        F.when(asks, question).when(role == "assistant", text).alias("said"),
        F.when(call, F.array(F.coalesce(_get(v, "$.name"), F.lit("?")))).otherwise(_none()).alias("used"),
        F.when(call, paths_of(F.try_parse_json(_get(v, "$.arguments")))).otherwise(_none()).alias("touched"),
        F.lit(None).cast("string").alias("titled"),
    )


def read_gemini(records: DataFrame) -> DataFrame:
    """The same of gemini records: content is plain text or a list; a ``toolCalls`` column (JSON text) is read if there is one."""
    kind, content = F.col("type"), F.col("content")
    is_list = content.startswith("[{") | (content == "[]")
    calls = F.try_parse_json("toolCalls") if "toolCalls" in records.columns else F.lit(None).cast("variant")
    r = records.withColumns({"_v": F.when(is_list, F.try_parse_json(content)), "_c": F.when(kind == "gemini", calls)})
    text = F.when(is_list, _joined(_blocks(F.col("_v")))).otherwise(strip(content))
    question = clean_blocks(text)
    asks = (kind == "user") & (question != "") & ~_starts(question, NOISE["gemini"])
    used = _blocks(F.col("_c"))
    return r.select(
        *records.columns,
        F.coalesce(asks, F.lit(False)).alias("asks"),
        F.when(asks, question).when(kind == "gemini", text).alias("said"),
        F.transform(used, lambda b: F.coalesce(_get(b, "$.name"), F.lit("?"))).alias("used"),
        F.flatten(F.transform(used, lambda b: paths_of(F.try_variant_get(b, "$.args", "variant")))).alias("touched"),
        F.lit(None).cast("string").alias("titled"),
    )


READERS = {"claude": read_claude, "codex": read_codex, "gemini": read_gemini}


def assemble(read: DataFrame, by: str = "session_id") -> DataFrame:
    """Turns (session_id, turn_no, agent, question, answer, started, cwd, repo, branch, session_title, tools, files) of read records.

    Answers are joined by newlines; tools and files are distinct and sorted; the last title holds for all turns.
    ``started``, cwd, branch and session_id are those of the question's record. What belongs together has the same ``by``
    (the file, where a log may lack identifiers) and is ordered by ``line``; NULLs in either are left out.
    """
    read = read.withColumn("_by", F.col(by)).where("_by is not null and line is not null")
    so_far = Window.partitionBy("_by").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = read.withColumn("turn_no", F.sum(F.col("asks").cast("int")).over(so_far))
    titles = read.where("titled is not null").groupBy("_by").agg(F.max_by("titled", "line").alias("session_title"))
    said = F.when(~F.col("asks") & (F.coalesce(F.col("said"), F.lit("")) != ""), F.struct("line", "said"))
    opening = lambda c: F.max(F.when(F.col("asks"), F.col(c)))
    g = t.where("turn_no > 0").groupBy("_by", "turn_no").agg(
        F.max("agent").alias("agent"),
        opening("session_id").alias("session_id"), opening("said").alias("question"),
        F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["said"]), "\n").alias("answer"),
        opening("timestamp").alias("started"), opening("cwd").alias("cwd"), opening("git_branch").alias("branch"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("used")))).alias("tools"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("touched")))).alias("files"),
    )
    g = g.join(titles, "_by", "left").withColumns({"repo": repo_of(F.col("cwd")), "session_title": F.coalesce("session_title", F.lit(""))})
    return g.select("session_id", "turn_no", "agent", "question", "answer", "started", "cwd", "repo", "branch", "session_title", "tools", "files")


def session_turns(records: DataFrame) -> DataFrame:
    """Turns of records of all agents; records of unknown agents are left out."""
    out = None
    for agent, reader in READERS.items():
        one = reader(records.where(F.col("agent") == agent))
        out = one if out is None else out.unionByName(one)
    return assemble(out)


def turn_columns() -> dict[str, Column]:
    """Title, text and summary of a turn as the document that is indexed."""
    from ..functions.text import turn_title

    q, a = F.coalesce(F.col("question"), F.lit("")), F.coalesce(F.col("answer"), F.lit(""))
    return {
        "title": turn_title(F.col("session_title"), q),
        "text": strip(F.concat(q, F.lit("\n\n"), a)),
        "answer_summary": summarize(a),
    }
