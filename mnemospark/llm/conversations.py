"""Problem 6: conversations rebuilt from message rows, in order and with roles; broken ones are left out.

Rows that carry no session identifier are put into conversations as connected components over their reply and
quote links, by alternating large-star and small-star joins; a log in which every row has one is not searched for
links. All conversations are then ordered and checked by
windows over (session, hour) and a second window over the few rows that sum up each hour, so that no task ever
holds a whole session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.instants import with_instant
from ..operators.components import connected_components
from ..operators.sessions import NOISE
from ..plans.times import INSTANTS_SQL
from ..session import cut, table
from .nearest_time import nearest_in_time

# The injected blocks.
INJECTED = r"(?s)<system-reminder>.*?</system-reminder>|<task-notification>.*?</task-notification>"

HOUR = 3_600_000_000
#: Longest time between a message and its reply at the same place.
REPLY_GAP = 20 * 60_000_000
_LACKING = "session_id is null or trim(session_id) = ''"


def _messages(records: DataFrame) -> DataFrame:
    """``records`` that can be messages by agent, type and flags, with their ``role`` and bare ``text`` ('' if none)."""
    agent, kind, content = F.lower(F.trim("agent")), F.col("type"), F.col("content")
    candidate = (
        ((agent == "claude") & kind.isin("user", "assistant"))
        | ((agent == "codex") & (kind == "response_item"))
        | ((agent == "gemini") & kind.isin("user", "gemini"))
    )
    is_json = content.startswith("{") | content.startswith("[{") | (content == "[]")
    r = records.where(candidate & content.isNotNull()).withColumns(
        {"_agent": agent, "_v": F.when(is_json, F.try_parse_json(content)), "_plain": F.when(~is_json, content)}
    )
    v = F.col("_v")

    def texts(blocks: Column, only: str | None = None) -> Column:
        items = F.try_variant_get(blocks, "$", "array<variant>")
        if only:
            items = F.filter(items, lambda b: F.try_variant_get(b, "$.type", "string") == only)
        return F.array_join(F.filter(F.transform(items, lambda b: F.try_variant_get(b, "$.text", "string")), lambda t: t != ""), "\n")

    inner = F.try_variant_get(v, "$.content", "variant")
    codex_text = F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(inner, "$", "string")).otherwise(texts(inner))
    codex_role = F.when(F.try_variant_get(v, "$.type", "string") == "message", F.try_variant_get(v, "$.role", "string"))
    r = r.withColumns(
        {
            "role": F.when(F.col("_agent") == "codex", F.when(codex_role.isin("user", "assistant"), codex_role))
            .when(kind == "user", F.lit("user"))
            .otherwise(F.lit("assistant")),
            "text": F.when(F.col("_agent") == "codex", codex_text)
            .when((F.col("_agent") == "claude") & (kind == "user"), F.col("_plain"))
            .when(F.col("_agent") == "claude", texts(v, "text"))
            .otherwise(F.coalesce(F.col("_plain"), texts(v))),
        }
    )
    bare = F.regexp_replace(F.regexp_replace(F.col("text"), INJECTED, ""), r"(?U)^\s+|\s+$", "")
    r = r.withColumn("text", F.coalesce(F.when(F.col("role").isNotNull(), bare), F.lit("")))
    start = F.regexp_replace(F.coalesce(F.col("_plain"), F.lit("")), r"(?U)^\s+", "")
    noise = F.lit(False)
    for name, prefixes in NOISE.items():
        for p in prefixes:
            hit = F.col("text").startswith(p) | start.startswith(p) if name == "claude" else F.col("text").startswith(p)
            noise = noise | ((F.col("_agent") == name) & hit)
    return r.withColumn("text", F.when((F.col("role") == "user") & noise, F.lit("")).otherwise(F.col("text"))).drop("_agent", "_v", "_plain")


def quote_links(messages: DataFrame) -> DataFrame:
    """(a, b): a message whose leading quoted line (``> ...``) is the first line of another, and the latest such message
    of the day before it, so that a stock phrase links no more than one. ``messages``: (rec_id, text, us). Lines under 20
    characters and messages without a time link nothing."""
    first = lambda mark: F.regexp_extract("text", rf"^\s*{mark}([^\r\n]+?)\s*(?:\r|\n|$)", 1)
    lines = messages.select("rec_id", "us", first("").alias("said"), first(r">\s*").alias("quoted"))
    said = lines.where((F.length("said") >= 20) & ~F.col("said").startswith(">")).select(F.col("said").alias("entity"), F.col("us").alias("t"), F.col("rec_id").alias("key"))
    asked = lines.where(F.length("quoted") >= 20).select(F.col("rec_id").alias("lid"), F.col("quoted").alias("entity"), F.col("us").alias("t"))
    return nearest_in_time(asked, said, back_us=24 * HOUR, forward_us=0, tick_us=3 * HOUR).select(F.col("lid").alias("a"), F.col("key").alias("b"))


def reply_links(messages: DataFrame, gap: int = REPLY_GAP) -> DataFrame:
    """(a, b): a message and the one before it at the same place (agent, machine and cwd; NULLs are alike), at most
    ``gap`` microseconds (one hour or less) earlier. ``messages``: (rec_id, agent, machine, cwd, us). Windows are over
    (place, hour); the first of an hour follows the last of the hour before."""
    place = F.sha2(F.concat_ws("\0", *[F.coalesce(F.trim(c), F.lit("")) for c in ("agent", "machine", "cwd")]), 256)
    hour = F.floor(F.col("us") / F.lit(HOUR)).cast("long")
    m = messages.where("us is not null").select("rec_id", "us", place.alias("place"), hour.alias("hour"))
    w = Window.partitionBy("place", "hour").orderBy("us", "rec_id")
    m = m.withColumns({"b": F.lag("rec_id").over(w), "before": F.lag("us").over(w)})
    last = m.groupBy("place", (F.col("hour") + 1).alias("hour")).agg(F.max(F.struct("us", "rec_id")).alias("last"))
    first = m.where("b is null").join(last, ["place", "hour"])
    over = first.select("rec_id", "us", F.col("last.rec_id").alias("b"), F.col("last.us").alias("before"))
    links = m.where("b is not null").select("rec_id", "us", "b", "before").unionAll(over)
    return links.where(F.col("us") - F.col("before") <= gap).select(F.col("rec_id").alias("a"), "b")


def assign_sessions(messages: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """``messages`` with every NULL or blank ``session_id`` filled by ``component:<smallest rec_id>``.

    Components run over quote links and the given ``replies`` (a, b: record ids) or else the reply links of time and
    place, among the rows without identifier only. A row without any link is a conversation of its own.
    """
    orphans = messages.where(_LACKING)
    links = quote_links(orphans)
    if replies is None:
        links = links.unionAll(reply_links(orphans))
    else:
        ids = orphans.select("rec_id").distinct()
        inside = replies.select("a", "b").join(ids.withColumnRenamed("rec_id", "a"), "a", "left_semi")
        links = links.unionAll(inside.join(ids.withColumnRenamed("rec_id", "b"), "b", "left_semi").select("a", "b"))
    components = connected_components(links)
    filled = orphans.join(components, orphans["rec_id"] == components["node"], "left").drop("node")
    filled = filled.withColumn("session_id", F.concat(F.lit("component:"), F.coalesce("component", "rec_id").cast("string")))
    return messages.where("session_id is not null and trim(session_id) <> ''").unionByName(filled.drop("component"))


def rebuild_conversations(records: DataFrame, machines: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """(session_id, pos, rec_id, role) of the messages of every conversation that is whole.

    Records alike in session, type, content and non-NULL timestamp are one, under the smallest id. A conversation is
    kept if it has messages, all with a usable time, starts with the user, and every user message is followed by an
    assistant message before the next user message or the end. Order is by time, then id. Records without session are put
    into one first, by ``replies`` (a, b) or else by time and place (with ``cwd``, if there is one). NULL flags count as false,
    NULL or unparsable content as no text, rows without ``rec_id`` are ignored; no records, no rows; further columns
    are dropped.
    """
    need = ["rec_id", "session_id", "agent", "type", "content", "timestamp", "machine", "is_meta", "is_sidechain"]
    cwd = F.col("cwd") if "cwd" in records.columns else F.lit(None).cast("string").alias("cwd")
    records = records.select(*need, cwd).where("rec_id is not null")
    m = with_instant(_messages(records), machines, "timestamp", "us")
    if not records.where(_LACKING).select("rec_id").isEmpty():
        m = assign_sessions(cut(m), replies)
    side = F.coalesce(F.col("is_meta"), F.lit(False)) | F.coalesce(F.col("is_sidechain"), F.lit(False))
    m = m.select(
        "session_id", "type", "rec_id", "role", "timestamp", "us",
        F.unhex(F.md5(F.col("content").cast("binary"))).alias("digest"),
        ((F.col("text") != "") & ~side).alias("ok"),
    )
    alone = F.when(F.col("timestamp").isNull(), F.col("rec_id"))
    m = m.groupBy("session_id", "type", "digest", "timestamp", alone.alias("alone")).agg(F.min(F.struct("rec_id", "role", "ok", "us")).alias("x"))
    m = m.select("session_id", "x.*").where("ok").select("session_id", "rec_id", "role", "us")

    hour = F.floor(F.col("us") / F.lit(HOUR)).cast("long")
    m = m.withColumn("hour", F.coalesce(hour, F.lit(-(1 << 62)))).repartition("session_id", "hour")
    inside = Window.partitionBy("session_id", "hour").orderBy("us", "rec_id")
    m = cut(m.withColumns({"n": F.row_number().over(inside), "prev": F.lag("role").over(inside)}))
    sums = m.groupBy("session_id", "hour").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.struct("n", "role"))["role"].alias("first"),
        F.max(F.struct("n", "role"))["role"].alias("last"),
        F.max(F.col("us").isNull() | ((F.col("role") == "user") & F.coalesce(F.col("prev") == "user", F.lit(False)))).alias("broken"),
    )
    over = Window.partitionBy("session_id").orderBy("hour")
    sums = sums.withColumns(
        {
            "start": F.sum("rows").over(over) - F.col("rows"),
            "broken": F.col("broken")
            | F.when(F.lag("last").over(over).isNull(), F.col("first") != "user").otherwise((F.lag("last").over(over) == "user") & (F.col("first") == "user"))
            | (F.lead("hour").over(over).isNull() & (F.col("last") == "user")),
        }
    )
    whole = sums.withColumn("bad", F.max("broken").over(Window.partitionBy("session_id"))).where("not bad")
    kept = m.join(whole.select("session_id", "hour", "start"), ["session_id", "hour"])
    return kept.select("session_id", (F.col("start") + F.col("n")).cast("long").alias("pos"), "rec_id", "role")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, pos, rec_id, role): the messages of every kept session of the message log."""
    return rebuild_conversations(table(spark, sf_dir, "message_records"), table(spark, sf_dir, "machines"))


def p6_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, pos, rec_id, role) of the whole message log as if no record had a session: conversations by links."""
    records = table(spark, sf_dir, "message_records").withColumn("session_id", F.lit(None).cast("string"))
    return rebuild_conversations(records, table(spark, sf_dir, "machines"))


QUERIES = {"p6_found": p6_found, "p6_linked": p6_linked}
_BLOCKS = "coalesce(CAST(CASE WHEN json_type({0}) = 'ARRAY' THEN {0} END AS JSON[]), [])"
_JOIN = "array_to_string(list_filter(list_transform({0}, lambda b: b->>'$.text'), lambda t: t <> ''), chr(10))"
_SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
_NOISY = {a: " OR ".join(f"starts_with(bare, '{p}')" for p in ps) for a, ps in NOISE.items()}
_P6 = f"""
WITH r AS (SELECT DISTINCT rec_id, session_id, agent, type, content, timestamp, machine, coalesce(is_meta, false) OR coalesce(is_sidechain, false) AS side, starts_with(content, '{{') OR starts_with(content, '[{{') OR content = '[]' AS js
             FROM message_records WHERE content IS NOT NULL AND (type IN ('user', 'assistant', 'response_item', 'gemini'))),
     v AS (SELECT *, CASE WHEN js AND json_valid(content) THEN content::JSON END AS j FROM r),
     x AS (SELECT *, CASE WHEN agent = 'codex' THEN CASE WHEN j->>'$.type' = 'message' AND j->>'$.role' IN ('user', 'assistant') THEN j->>'$.role' END WHEN type = 'user' THEN 'user' ELSE 'assistant' END AS role,
             CASE WHEN agent = 'codex' THEN {_JOIN.format(_BLOCKS.format("(j->'$.content')"))} WHEN agent = 'claude' AND type = 'user' THEN CASE WHEN NOT js THEN content END
                  WHEN agent = 'claude' THEN {_JOIN.format("list_filter(" + _BLOCKS.format("j") + ", lambda b: b->>'$.type' = 'text')")} WHEN NOT js THEN content ELSE {_JOIN.format(_BLOCKS.format("j"))} END AS text FROM v),
     b AS (SELECT *, regexp_replace(regexp_replace(text, '{INJECTED}', '', 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS bare, regexp_replace(content, '^{_SPACE}+', '') AS raw FROM x WHERE role IS NOT NULL),
     m AS (SELECT *, bare <> '' AND NOT side AND NOT (role = 'user' AND CASE agent WHEN 'claude' THEN {_NOISY["claude"]} OR {_NOISY["claude"].replace("(bare", "(raw")} WHEN 'codex' THEN {_NOISY["codex"]} ELSE {_NOISY["gemini"]} END) AS ok FROM b),
     u AS (SELECT DISTINCT row_id, us FROM ({INSTANTS_SQL}) WHERE src = 'message'),
     d AS (SELECT session_id, min(rec_id) AS rec_id, arg_min(role, rec_id) AS role, arg_min(ok, rec_id) AS ok, min(timestamp) AS ts FROM m GROUP BY session_id, type, content, timestamp, CASE WHEN timestamp IS NULL THEN rec_id END),
     t AS (SELECT d.*, CASE WHEN regexp_full_match(ts, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}\\.\\d{{3}}Z') THEN epoch_us(try_strptime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')) ELSE u.us END AS us FROM d LEFT JOIN u ON u.row_id = d.rec_id WHERE ok),
     o AS (SELECT *, row_number() OVER w AS pos, lead(role) OVER w AS after FROM t WINDOW w AS (PARTITION BY session_id ORDER BY us, rec_id)),
     k AS (SELECT session_id FROM o GROUP BY session_id HAVING bool_and(us IS NOT NULL) AND arg_min(role, pos) = 'user' AND bool_and(role <> 'user' OR coalesce(after, '') = 'assistant'))
SELECT session_id, pos::BIGINT AS pos, rec_id, role FROM o WHERE session_id IN (SELECT session_id FROM k)
"""
_ISLANDS = f"""
WITH n AS (SELECT DISTINCT rec_id, row_id, coalesce(trim(agent), '') || chr(0) || coalesce(trim(machine), '') || chr(0) || coalesce(trim(cwd), '') AS place, CASE WHEN regexp_full_match(timestamp, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}\\.\\d{{3}}Z') THEN epoch_us(try_strptime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ')) ELSE us END AS us
             FROM message_records LEFT JOIN (SELECT DISTINCT row_id, us FROM ({INSTANTS_SQL}) WHERE src = 'message') ON row_id = rec_id
            WHERE content IS NOT NULL AND ((agent = 'claude' AND type IN ('user', 'assistant')) OR (agent = 'codex' AND type = 'response_item') OR (agent = 'gemini' AND type IN ('user', 'gemini')))),
     g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY place ORDER BY us, rec_id) <= {REPLY_GAP} THEN 0 ELSE 1 END AS starts FROM n WHERE us IS NOT NULL),
     i AS (SELECT *, sum(starts) OVER (PARTITION BY place ORDER BY us, rec_id) AS island FROM g),
     c AS (SELECT rec_id, min(rec_id) OVER (PARTITION BY place, island) AS one FROM i)
SELECT m.* REPLACE ('component:' || coalesce(c.one, m.rec_id) AS session_id) FROM message_records m LEFT JOIN c ON c.rec_id = m.rec_id
"""
SQL = {"p6_found": _P6, "p6_linked": _P6.replace("FROM message_records WHERE content IS NOT NULL", f"FROM ({_ISLANDS}) WHERE content IS NOT NULL")}
