"""Queries over the engine's own operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import redact as R
from ..functions import text as X
from ..operators import chunking, linking, search, sessions, store
from ..session import table

QUERY = "retry guard in the rehearsal_overture harvest"
PREFIX_QUERY = "over test_"
PHRASE_QUERY = "count_rises last-month 테스트"


class _Sql(str):
    """SQL with places {0}, {1}; other braces stay as they are."""

    def format(self, *parts: str) -> _Sql:
        out = str(self)
        for k, x in enumerate(parts):
            out = out.replace("{" + str(k) + "}", x)
        return _Sql(out)


_folding = X.folding()
_q = lambda s: "'" + s.replace("'", "''") + "'"
_STRIP = _Sql(r"regexp_replace({0}, '^[\s\p{Z}\x0b\x1c-\x1f\x85]+|[\s\p{Z}\x0b\x1c-\x1f\x85]+$', '', 'g')")
_TOKENS = _Sql("regexp_extract_all(translate(lower(coalesce({0}, '')), " + _q(_folding[0]) + ", " + _q(_folding[1]) + r"), '[\p{L}\p{N}\p{Co}]+')")
_WORDS = _Sql(r"list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+'))")
_D = "SELECT *, lower(trim(source)) AS source_type FROM documents"
_T = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY ingested_at) AS rn FROM turns) WHERE rn = 1"
_LINES = _Sql(r"CASE WHEN {0} = '' THEN [] ELSE string_split_regex(regexp_replace({0}, '(\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}])$', ''), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') END")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumn("source_type", F.lower(F.trim("source")))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("turn_id").orderBy("ingested_at")
    t = table(spark, sf, "turns").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return t.withColumn("t", F.unix_micros(F.col("when_ts").cast("timestamp")))


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# -- records and text -------------------------------------------------------------------------------------------
def doc_normalize(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    return d.select(
        "doc_id", X.make_id(F.col("source_type"), F.col("repo"), F.col("path"), F.col("doc_id")).alias("new_id"), X.first_line(F.col("text")).alias("first_line"),
        F.size(X.lines(F.col("text"))).cast("long").alias("n_lines"), X.language_of(F.col("path")).alias("language"),
    )


_LANG = "CASE " + " ".join(f"WHEN ext = '{e}' THEN '{v}'" for e, v in X.LANGUAGES.items()) + " ELSE 'text' END"
_EXT = r"lower(regexp_extract(regexp_extract(regexp_replace(path, '/+$', ''), '[^/]*$'), '[^.](\.[^.]+)$', 1))"
DOC_NORMALIZE = f"""
SELECT doc_id, source_type || ':' || substr(sha1(source_type || chr(0) || coalesce(repo, 'None') || chr(0) || coalesce(path, 'None') || chr(0) || doc_id), 1, 16) AS new_id,
       substr(coalesce(ls[1], ''), 1, 80) AS first_line, len(ls)::BIGINT AS n_lines, {_LANG} AS language
FROM (SELECT *, {_LINES.format("text")} AS ls, {_EXT} AS ext FROM ({_D}))
"""


def redact_all(spark: SparkSession, sf: str) -> DataFrame:
    d = R.redact_columns(_docs(spark, sf).select("doc_id", "text"), ["text"]).where("n_masked > 0")
    return d.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.col("n_masked").cast("long").alias("n_masked"))


def _redact_sql() -> str:
    sql, count = "SELECT doc_id, text AS x, 0 AS n FROM documents", ""
    kv = rf"(?i)\b({R.KEYWORDS})\b(\s*[=:]\s*)(?:\"([^\s\"''«]{{6,}})\"|''([^\s\"''«]{{6,}})''|([^\s\"''«]{{6,}}))"
    steps = [(p.replace("'", "''"), R.mask(label)) for p, label in R.RULES] + [(kv, r"\1\2" + R.mask("SECRET"))]
    for p, to in steps:
        sql = f"SELECT doc_id, regexp_replace(x, '{p}', '{to}', 'g') AS x, n + coalesce(len(regexp_extract_all(x, '{p}')), 0) AS n FROM ({sql})"
    return f"SELECT doc_id, md5(x) AS digest, n::BIGINT AS n_masked FROM ({sql}) WHERE n > 0{count}"


def redact_entropy(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({R.CANDIDATE})")))).alias("token"))
    return d.where(X.looks_secret(F.col("token"))).select("doc_id", "token", F.round(X.entropy(F.col("token")), 6).alias("bits"))


REDACT_ENTROPY = rf"""
WITH c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{R.CANDIDATE}')) AS token FROM documents),
     e AS (SELECT token, -sum(p * log2(p)) AS bits FROM (SELECT token, count(*) / length(token) AS p FROM (SELECT token, unnest(string_split(token, '')) AS ch FROM (SELECT DISTINCT token FROM c)) GROUP BY token, ch) GROUP BY token)
SELECT doc_id, token, round(bits, 6) AS bits FROM c JOIN e USING (token)
WHERE bits > 4.0 AND regexp_matches(token, '\p{{Lu}}') AND regexp_matches(token, '\p{{Ll}}') AND regexp_matches(token, '\p{{Nd}}')
"""


def redact_high(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, digest, n_masked) of the documents that masking with the entropy rule changes."""
    d = R.redact_columns(_docs(spark, sf).select("doc_id", "text"), ["text"], high_entropy=True).where("n_masked > 0")
    return d.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.col("n_masked").cast("long").alias("n_masked"))


def _redact_high_sql() -> str:
    label = R.mask("HIGH_ENTROPY")
    base = _redact_sql().replace("md5(x) AS digest, n::BIGINT AS n_masked", "x, n").replace(" WHERE n > 0", "")
    return rf"""
WITH b AS ({base}), c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(x, '{R.CANDIDATE}')) AS token FROM b),
     e AS (SELECT token, -sum(p * log2(p)) AS bits FROM (SELECT token, count(*) / length(token) AS p FROM (SELECT token, unnest(string_split(token, '')) AS ch FROM (SELECT DISTINCT token FROM c)) GROUP BY token, ch) GROUP BY token),
     s AS (SELECT doc_id, list(token ORDER BY length(token) DESC, token) AS ts FROM c JOIN e USING (token)
           WHERE bits > 4.0 AND regexp_matches(token, '\p{{Lu}}') AND regexp_matches(token, '\p{{Ll}}') AND regexp_matches(token, '\p{{Nd}}') GROUP BY doc_id),
     m AS (SELECT doc_id, n, list_reduce(list_concat([x], coalesce(ts, [])), lambda t, token: replace(t, token, '{label}')) AS x FROM b LEFT JOIN s USING (doc_id))
SELECT doc_id, md5(x) AS digest, (n + (length(x) - length(replace(x, '{label}', ''))) // length('{label}'))::BIGINT AS n_masked FROM m WHERE n_masked > 0
"""


def clean_blocks(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "message_records").where(F.col("content").contains("<system-reminder>") | F.col("content").contains("<task-notification>"))
    return m.select("rec_id", F.md5(X.clean_blocks(F.col("content")).cast("binary")).alias("digest")).distinct()


_CLEAN = _STRIP.format(r"regexp_replace(regexp_replace({0}, '(?s)<system-reminder>.*?</system-reminder>', '', 'g'), '(?s)<task-notification>.*?</task-notification>', '', 'g')")
CLEAN_BLOCKS = f"""
SELECT DISTINCT rec_id, md5({_CLEAN.format("content")}) AS digest FROM message_records
WHERE content LIKE '%<system-reminder>%' OR content LIKE '%<task-notification>%'
"""


def turn_documents(spark: SparkSession, sf: str) -> DataFrame:
    t = _turns(spark, sf)
    c = sessions.turn_columns()
    return t.select(
        "turn_id", X.make_id("agent_turn", F.col("session_id"), F.col("t"), F.substring("question", 1, 120)).alias("id"), c["title"].alias("title"),
        F.md5(c["text"].cast("binary")).alias("digest"), c["answer_summary"].alias("answer_summary"), X.repo_of(F.col("cwd")).alias("repo_name"),
    )


_SENT = r"string_split(regexp_replace(regexp_replace(a, '([.!?。])\s+', '\1' || chr(1), 'g'), '([다요죠음])\s+', '\1' || chr(1), 'g'), chr(1))"
TURN_DOCUMENTS = f"""
WITH t AS ({_T}),
     s AS (SELECT *, {_STRIP.format(r"regexp_replace(coalesce(answer, ''), '[\s\p{Z}\x0b\x1c-\x1f\x85]+', ' ', 'g')")} AS a FROM t),
     p AS (SELECT *, coalesce(list_filter({_SENT}, lambda x: length(trim(x)) > 8)[1], a) AS f, {_LINES.format("question")} AS ls FROM s)
SELECT turn_id, 'agent_turn:' || substr(sha1('agent_turn' || chr(0) || coalesce(session_id, 'None') || chr(0) || coalesce(epoch_us(when_ts)::VARCHAR, 'None') || chr(0) || substr(question, 1, 120)), 1, 16) AS id,
       CASE WHEN coalesce(session_title, '') <> '' THEN session_title ELSE substr(coalesce(ls[1], ''), 1, 80) END AS title,
       md5({_STRIP.format("coalesce(question, '') || chr(10) || chr(10) || coalesce(answer, '')")}) AS digest,
       CASE WHEN length(f) <= 130 THEN f ELSE substr(f, 1, 129) || '…' END AS answer_summary,
       CASE WHEN coalesce(cwd, '') = '' THEN '(unknown)' ELSE regexp_extract(regexp_replace(cwd, '/+$', ''), '[^/]*$') END AS repo_name
FROM p
"""


# -- sessions ---------------------------------------------------------------------------------------------------
def _records(spark: SparkSession, sf: str, agent: str) -> DataFrame:
    m = table(spark, sf, "message_records").where(F.col("agent") == agent)
    one = m.groupBy("rec_id").agg(F.min(F.struct(*[c for c in m.columns if c != "rec_id"])).alias("x"))  # repeats are alike but for their arrival
    return one.select("rec_id", "x.*").withColumn("line", F.col("rec_id"))


def _session_turns(spark: SparkSession, sf: str, agent: str) -> DataFrame:
    t = sessions.assemble(sessions.READERS[agent](_records(spark, sf, agent)))
    out = t.select("session_id", "turn_no", "question", "answer", F.array_join("tools", ",").alias("tools"), F.array_join("files", ",").alias("files"), "repo", "session_title")
    return _long(out, "turn_no")


def turns_claude(spark: SparkSession, sf: str) -> DataFrame:
    return _session_turns(spark, sf, "claude")


def turns_codex(spark: SparkSession, sf: str) -> DataFrame:
    return _session_turns(spark, sf, "codex")


def turns_gemini(spark: SparkSession, sf: str) -> DataFrame:
    return _session_turns(spark, sf, "gemini")


def _turns_sql(agent: str) -> str:
    noise = " OR ".join(f"starts_with(%s, {_q(p)})" for p in sessions.NOISE[agent])
    lstrip = r"regexp_replace(content, '^[\s\p{Z}\x0b\x1c-\x1f\x85]+', '')"
    texts = "list_filter(list_transform(list_filter({0}, lambda b: {1}), lambda b: b->>'$.text'), lambda t: t <> '')"
    joined = _STRIP.format("coalesce(array_to_string(" + texts + ", chr(10)), '')")
    is_list = "(starts_with(content, '[{') OR content = '[]')"
    blocks = _Sql("coalesce(CAST(CASE WHEN json_type({0}) = 'ARRAY' THEN {0} END AS JSON[]), [])")
    none = "CAST([] AS VARCHAR[])"
    title = "NULL"
    if agent == "claude":
        js = f"CASE WHEN type = 'assistant' AND {is_list} AND json_valid(content) THEN content::JSON END"
        asks = f"type = 'user' AND NOT coalesce(is_meta, false) AND NOT coalesce(is_sidechain, false) AND NOT {is_list} AND {lstrip} <> '' AND NOT ({noise.replace('%s', lstrip)})"
        say = f"CASE WHEN asks THEN {_CLEAN.format('content')} ELSE {joined.format(blocks.format('j'), chr(98) + chr(45) + '>>' + chr(39) + '$.type' + chr(39) + ' = ' + chr(39) + 'text' + chr(39))} END"
        used = f"list_transform(list_filter({blocks.format('j')}, lambda b: b->>'$.type' = 'tool_use'), lambda b: coalesce(b->>'$.name', '?'))"
        files = f"list_filter(list_transform(list_filter({blocks.format('j')}, lambda b: b->>'$.type' = 'tool_use'), lambda b: coalesce(nullif(b->>'$.input.file_path', ''), nullif(b->>'$.input.path', ''), nullif(b->>'$.input.notebook_path', ''))), lambda p: p IS NOT NULL)"
        title = "CASE WHEN type = 'ai-title' THEN nullif(content, '') END"
    elif agent == "codex":
        js = "CASE WHEN type = 'response_item' AND json_valid(content) THEN content::JSON END"
        msg = f"CASE WHEN j->>'$.type' = 'message' THEN {joined.format(blocks.format(chr(40) + 'j->' + chr(39) + '$.content' + chr(39) + chr(41)), 'true')} END"
        q = _CLEAN.format(f"({msg})")
        asks = f"coalesce(j->>'$.role' = 'user' AND {q} <> '' AND NOT ({noise.replace('%s', q)}), false)"
        say = f"CASE WHEN asks THEN {q} WHEN j->>'$.role' = 'assistant' THEN {msg} END"
        call = "j->>'$.type' = 'function_call'"
        args = "(CASE WHEN json_valid(j->>'$.arguments') THEN (j->>'$.arguments')::JSON END)"
        used = f"CASE WHEN {call} THEN [coalesce(j->>'$.name', '?')] ELSE {none} END"
        keys = ", ".join(f"CASE WHEN json_type({args}->'$.{k}') = 'VARCHAR' THEN {args}->>'$.{k}' END" for k in X.PATH_KEYS)
        files = f"CASE WHEN {call} THEN list_filter([{keys}], lambda p: p IS NOT NULL) ELSE {none} END"
    else:
        js = f"CASE WHEN {is_list} AND json_valid(content) THEN content::JSON END"
        text = f"CASE WHEN {is_list} THEN {joined.format(blocks.format('j'), 'true')} ELSE {_STRIP.format('content')} END"
        q = _CLEAN.format(f"({text})")
        asks = f"coalesce(type = 'user' AND {q} <> '' AND NOT ({noise.replace('%s', q)}), false)"
        say = f"CASE WHEN asks THEN {q} WHEN type = 'gemini' THEN {text} END"
        used, files = none, none
    return f"""
WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY ingested_at) AS rn FROM message_records WHERE agent = '{agent}') WHERE rn = 1),
     v AS (SELECT *, {js} AS j FROM r),
     a AS (SELECT *, coalesce({asks}, false) AS asks FROM v),
     s AS (SELECT session_id, rec_id, asks, cwd, {say} AS said, {used} AS used, {files} AS touched, {title} AS titled FROM a),
     n AS (SELECT *, sum(asks::INT) OVER (PARTITION BY session_id ORDER BY rec_id) AS turn_no FROM s),
     t AS (SELECT session_id, max_by(titled, rec_id) AS session_title FROM s WHERE titled IS NOT NULL GROUP BY session_id),
     g AS (SELECT session_id, turn_no, max(CASE WHEN asks THEN said END) AS question, max(CASE WHEN asks THEN cwd END) AS cwd,
                  coalesce(string_agg(CASE WHEN NOT asks AND coalesce(said, '') <> '' THEN said END, chr(10) ORDER BY rec_id), '') AS answer,
                  array_to_string(list_sort(list_distinct(flatten(list(used)))), ',') AS tools, array_to_string(list_sort(list_distinct(flatten(list(touched)))), ',') AS files
           FROM n WHERE turn_no > 0 GROUP BY session_id, turn_no)
SELECT session_id, turn_no::BIGINT AS turn_no, question, answer, coalesce(tools, '') AS tools, coalesce(files, '') AS files,
       CASE WHEN coalesce(cwd, '') = '' THEN '(unknown)' ELSE regexp_extract(regexp_replace(cwd, '/+$', ''), '[^/]*$') END AS repo, coalesce(session_title, '') AS session_title
FROM g LEFT JOIN t USING (session_id)
"""


# -- links ------------------------------------------------------------------------------------------------------
def _links(spark: SparkSession, sf: str) -> DataFrame:
    turns = _turns(spark, sf).select("turn_id", "cwd", "t", "files")
    commits = table(spark, sf, "commit_log").withColumn("t", F.unix_micros(F.col("committed_at").cast("timestamp")))
    return linking.link_commits(turns, commits.select("cwd", "t", "short_sha", "subject", "files"))


def link_commits(spark: SparkSession, sf: str) -> DataFrame:
    return _long(_links(spark, sf), "rank")


_NAMES = _Sql(r"list_distinct(list_transform(coalesce({0}, []), lambda p: regexp_extract(regexp_replace(p, '/+$', ''), '[^/]*$')))")
LINK_COMMITS = f"""
WITH t AS (SELECT turn_id, cwd, epoch_us(when_ts) AS t, {_NAMES.format("files")} AS f FROM ({_T}) WHERE cwd IS NOT NULL AND trim(cwd) <> '' AND when_ts IS NOT NULL),
     c AS (SELECT cwd, short_sha, any_value(epoch_us(committed_at)) AS t, any_value(subject) AS subject, any_value({_NAMES.format("files")}) AS f FROM commit_log GROUP BY cwd, short_sha),
     n AS (SELECT turn_id, short_sha, subject, c.t - t.t AS delay, len(list_intersect(t.f, c.f)) AS common, len(c.f) > 0 AS listed
           FROM t JOIN c ON t.cwd = c.cwd AND c.t BETWEEN t.t AND t.t + 10800000000),
     r AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY common DESC, listed DESC, delay, short_sha) AS rank FROM n)
SELECT turn_id, rank::BIGINT AS rank, short_sha, subject, CASE WHEN common > 0 THEN 'file' ELSE 'time' END AS kind
FROM r WHERE rank <= 3 AND (common > 0 OR rank = 1)
"""


def work_signal(spark: SparkSession, sf: str) -> DataFrame:
    kinds = _links(spark, sf).groupBy("turn_id").agg(F.collect_list(F.struct("kind")).alias("found"))
    t = _turns(spark, sf).select("turn_id", "files").join(kinds, "turn_id", "left")
    return t.select("turn_id", X.has_work(F.lit("agent_turn"), F.col("files"), F.col("found")).alias("works"))


WORK_SIGNAL = f"""
WITH l AS ({LINK_COMMITS}), k AS (SELECT turn_id, bool_or(kind = 'file') AS by_file FROM l GROUP BY turn_id)
SELECT t.turn_id, coalesce(len(t.files), 0) > 0 OR coalesce(k.by_file, false) AS works FROM ({_T}) t LEFT JOIN k USING (turn_id)
"""


# -- chunks -----------------------------------------------------------------------------------------------------
def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    c = chunking.chunk_lines(_docs(spark, sf).where("text is not null").select("doc_id", "text"))
    return _long(c.select("doc_id", "start_line", "end_line", F.md5(F.col("chunk").cast("binary")).alias("digest")), "start_line", "end_line")


CHUNK_WINDOWS = f"""
WITH l AS (SELECT doc_id, {_LINES.format("text")} AS ls FROM documents WHERE text IS NOT NULL),
     w AS (SELECT doc_id, ls, unnest(CASE WHEN len(ls) > 0 THEN range(0, greatest(0, (ceil((len(ls) - 60) / 45.0) * 45)::BIGINT) + 1, 45) ELSE [] END) AS s FROM l)
SELECT doc_id, s + 1 AS start_line, least(s + 60, len(ls)) AS end_line, md5(array_to_string(ls[s + 1:least(s + 60, len(ls))], chr(10))) AS digest FROM w
"""


def chunk_symbols(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).where("source_type = 'code' and text is not null").select("doc_id", "text", X.language_of(F.col("path")).alias("lang"))
    c = chunking.chunk_symbols(d)
    return _long(c.select("doc_id", "start_line", "end_line", F.md5(F.col("chunk").cast("binary")).alias("digest")), "start_line", "end_line")


def _chunk_sql() -> str:
    py, brace = (p.replace("'", "''") for p in (chunking.PYTHON_DECLARATION, chunking.BRACE_DECLARATION))
    braces = ", ".join(f"'{x}'" for x in chunking.BRACE_LANGUAGES)
    return f"""
WITH d AS (SELECT doc_id, text, {_EXT} AS ext FROM ({_D}) WHERE source_type = 'code' AND text IS NOT NULL),
     l AS (SELECT doc_id, {_LANG} AS lang, {_LINES.format("text")} AS ls FROM d),
     b AS (SELECT *, list_filter(range(0, len(ls)), lambda i: CASE WHEN lang = 'python' THEN regexp_matches(ls[i + 1], '{py}') WHEN lang IN ({braces}) THEN regexp_matches(ls[i + 1], '{brace}') ELSE false END) AS st FROM l),
     c AS (SELECT *, list_sort(list_distinct(list_concat(list_concat([0], st), [len(ls)]))) AS cuts FROM b WHERE len(ls) > 0),
     s AS (SELECT doc_id, ls, len(st) = 0 AS plain, cuts[k] AS a, cuts[k + 1] AS e FROM (SELECT *, unnest(range(1, len(cuts))) AS k FROM c)),
     w AS (SELECT doc_id, ls, a, e, unnest(CASE WHEN plain OR e - a > 120 THEN range(0, greatest(0, (ceil((e - a - 60) / 45.0) * 45)::BIGINT) + 1, 45) ELSE [-1] END) AS o FROM s),
     x AS (SELECT doc_id, ls, CASE WHEN o < 0 THEN a ELSE a + o END AS p, CASE WHEN o < 0 THEN e ELSE least(a + o + 60, e) END AS q FROM w)
SELECT doc_id, p + 1 AS start_line, q AS end_line, md5(array_to_string(ls[p + 1:q], chr(10))) AS digest FROM x
"""


# -- index and rankings -----------------------------------------------------------------------------------------
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = search.postings(_docs(spark, sf).select(F.col("doc_id").alias("id"), "title", "text"))
    return p.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("df"), F.max("pos").cast("long").alias("last_pos"))


def _post_sql(corpus: str = "documents") -> str:
    one = lambda f: f"SELECT doc_id, '{f}' AS field, unnest(generate_series(0, len(t) - 1)) AS pos, unnest(t) AS token FROM (SELECT doc_id, {_TOKENS.format(f)} AS t FROM {corpus})"
    return one("title") + " UNION ALL " + one("text")


_POST = _post_sql()
TOKEN_COUNTS = f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS df, max(pos)::BIGINT AS last_pos FROM ({_POST}) GROUP BY token"


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return search.corpus_stats(search.doc_lengths(_docs(spark, sf).select(F.col("doc_id").alias("id"), "title", "text")))


CORPUS_STATS = f"SELECT count(*) AS n_docs, sum(len({_TOKENS.format('title')}) + len({_TOKENS.format('text')}))::BIGINT AS total_tokens FROM documents"


def _lexical(spark: SparkSession, sf: str, query: str, k: int, **filters) -> DataFrame:
    d = _docs(spark, sf).select(F.col("doc_id").alias("id"), "title", "text", "source_type", "repo", "lang")
    top = search.lexical_topk(d, query, k, **filters)
    return _long(top.select("doc_id", F.round("score", 6).alias("score"), "rank"), "rank")


def _lexical_sql(query: str, k: int, where: str = "true", shape: str = "SELECT doc_id, round(score, 6) AS score, rank::BIGINT AS rank FROM top", corpus: str = "") -> str:
    parts = []
    for n, tokens in enumerate(search.query_phrases(query)):
        frm, cond = [], []
        for i, t in enumerate(tokens):
            frm.append(f"p AS p{i}")
            cond.append(f"starts_with(p{i}.token, {_q(t)})" if i == len(tokens) - 1 else f"p{i}.token = {_q(t)}")
            if i:
                cond.append(f"p{i}.doc_id = p0.doc_id AND p{i}.field = p0.field AND p{i}.pos = p0.pos + {i}")
        parts.append(f"SELECT p0.doc_id, {n} AS phrase, count(*) AS tf FROM {', '.join(frm)} WHERE {' AND '.join(cond)} GROUP BY p0.doc_id")
    return f"""
WITH p AS MATERIALIZED ({_post_sql(corpus or "documents")}), dl AS (SELECT doc_id, len({_TOKENS.format("title")}) + len({_TOKENS.format("text")}) AS dl FROM {corpus or "documents"}),
     st AS (SELECT count(*) AS n, sum(dl) / count(*) AS mean FROM dl), h AS ({" UNION ALL ".join(parts)}),
     df AS (SELECT phrase, count(*) AS df FROM h GROUP BY phrase),
     sc AS (SELECT doc_id, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score
            FROM h JOIN df USING (phrase) JOIN dl USING (doc_id), st GROUP BY doc_id),
     top AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE doc_id IN (SELECT doc_id FROM {corpus or '(' + _D + ')'} WHERE {where}) QUALIFY rank <= {k})
{shape}
"""


def lexical_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _lexical(spark, sf, QUERY, 50)


def lexical_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _lexical(spark, sf, QUERY, 20, source_type="note")


def lexical_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return _lexical(spark, sf, PREFIX_QUERY, 30)


def lexical_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return _lexical(spark, sf, PHRASE_QUERY, 30)


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    row = table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]]


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    return _long(search.vector_topk(v, _query_vector(spark, sf), 20).select("doc_id", F.round("score", 5).alias("score"), "rank"), "rank")


def vector_filtered(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    v = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    keep = e.where("label >= 5").select(F.col("vec_id").alias("doc_id"))
    return _long(search.vector_topk(v, _query_vector(spark, sf), 10, keep).select("doc_id", F.round("score", 5).alias("score"), "rank"), "rank")


def vector_dim_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    return _long(search.vector_topk(v, _query_vector(spark, sf)[:-1], 10), "rank")


def _vector_sql(k: int, where: str = "true") -> str:
    return f"""
WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
     s AS (SELECT vec_id AS doc_id, list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q)) + 1e-9) AS score FROM embeddings, q WHERE {where})
SELECT doc_id, round(score, 5) AS score, row_number() OVER (ORDER BY score DESC, doc_id)::BIGINT AS rank FROM s QUALIFY rank <= {k}
"""


def _fused(spark: SparkSession, sf: str, k: int) -> DataFrame:
    a = _lexical(spark, sf, QUERY, 60).select("doc_id", "rank")
    b = vector_topk(spark, sf).select("doc_id", "rank")
    return search.rrf_fuse([a, b], k)


def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _long(_fused(spark, sf, 40).select("doc_id", F.round("score", 8).alias("score"), "rank"), "rank")


HYBRID_TOPK = f"""
WITH a AS ({_lexical_sql(QUERY, 60)}), b AS ({_vector_sql(20)}),
     u AS (SELECT doc_id, 0 AS l, rank FROM a UNION ALL SELECT doc_id, 1, rank FROM b),
     f AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(l * 1000000 + rank) AS seen FROM u GROUP BY doc_id)
SELECT doc_id, round(score, 8) AS score, row_number() OVER (ORDER BY round(score, 12) DESC, seen)::BIGINT AS rank FROM f QUALIFY rank <= 40
"""


REQUEST = "why does the retry in the counter skip a guard"
_TALK = f"(SELECT turn_id AS doc_id, session_title AS title, concat_ws(chr(10), question, answer) AS text FROM ({_T}))"


def _request(spark: SparkSession, sf: str) -> DataFrame:
    """The hits (turn_id, rank) of a text request to all turns: the pool that re-ranking and collapsing work on."""
    t = _turns(spark, sf).select(F.col("turn_id").alias("id"), F.col("session_title").alias("title"), F.concat_ws("\n", "question", "answer").alias("text"))
    return search.lexical_topk(t, REQUEST, 300).select(F.col("doc_id").alias("turn_id"), "rank")


_REQUEST = _lexical_sql(REQUEST, 300, shape="SELECT doc_id AS turn_id, rank FROM top", corpus=_TALK)


def rerank(spark: SparkSession, sf: str) -> DataFrame:
    """The hits of a request with those that are no work further down."""
    return _long(search.rerank(work_signal(spark, sf).join(F.broadcast(_request(spark, sf)), "turn_id")).select("turn_id", "rank"), "rank")


RERANK = f"""
WITH n AS ({_REQUEST}), w AS ({WORK_SIGNAL})
SELECT turn_id, row_number() OVER (ORDER BY rank + CASE WHEN works THEN 0 ELSE 8 END, rank)::BIGINT AS rank FROM n JOIN w USING (turn_id)
"""


def dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The hits of a request without repeated questions."""
    t = _turns(spark, sf).select("turn_id", X.word_set(F.col("question")).alias("words")).join(F.broadcast(_request(spark, sf)), "turn_id")
    return search.collapse(t.withColumnRenamed("turn_id", "doc_id")).select(F.col("doc_id").alias("turn_id"), F.col("rank").cast("long").alias("rank"))


def _collapse_sql(hits: str, result: str) -> str:
    """Of ``hits`` (id, rank, w) those that are not like a kept one further up, as ``result`` over t and kept ranks."""
    return f"""
WITH RECURSIVE t AS MATERIALIZED ({hits}),
     x AS MATERIALIZED (SELECT a.rank AS a, b.rank AS b FROM t a JOIN t b ON a.rank > b.rank AND len(list_intersect(a.w, b.w)) >= 0.8 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AND len(a.w) > 0),
     k AS (SELECT 0::BIGINT AS rank, CAST([] AS BIGINT[]) AS kept UNION ALL
           SELECT k.rank + 1, CASE WHEN EXISTS (SELECT 1 FROM x WHERE x.a = k.rank + 1 AND list_contains(k.kept, x.b)) THEN kept ELSE list_append(kept, k.rank + 1) END FROM k WHERE k.rank < (SELECT max(rank) FROM t)),
     z AS (SELECT kept FROM k ORDER BY k.rank DESC LIMIT 1)
{result}
"""


DEDUP = _collapse_sql(
    f"SELECT turn_id, rank::BIGINT AS rank, {_WORDS.format('question')} AS w FROM ({_REQUEST}) JOIN ({_T}) USING (turn_id)", "SELECT turn_id, rank FROM t WHERE list_contains((SELECT kept FROM z), t.rank)"
)


def _memory(spark: SparkSession, sf: str) -> DataFrame:
    """All turns and documents in one shape, as the index holds them: turns with their times, files and linked commits."""
    none = F.array().cast("array<string>")
    linked = _links(spark, sf).groupBy("turn_id").agg(F.collect_list(F.struct("kind")).alias("commits"))
    t = _turns(spark, sf).drop("commits").join(linked, "turn_id", "left").select(
        F.concat(F.lit("t"), "turn_id").alias("id"), F.lit("agent_turn").alias("source_type"), "repo", F.col("session_title").alias("title"), F.concat_ws("\n", "question", "answer").alias("text"),
        F.timestamp_micros("t").alias("ts"), "question", F.coalesce("files", none).alias("files"), "commits",
    )
    d = _docs(spark, sf).select(
        F.concat(F.lit("d"), "doc_id").alias("id"), "source_type", "repo", "title", "text", F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("question"),
        none.alias("files"), F.lit(None).cast("array<struct<kind:string>>").alias("commits"),
    )
    return t.unionByName(d)


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """One vector a document of the current model."""
    v = table(spark, sf, "vectors").where("model_id = 'hash64-v1' and vec is not null and doc_id is not null")
    one = v.groupBy("doc_id").agg(F.min(F.struct("vec_id", "vec")).alias("x"))
    return one.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.col("x.vec").alias("vec"))


def retrieve_full(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid retrieval over all turns and documents: text and vector lists fused, work before talk, repeats collapsed."""
    v = table(spark, sf, "vectors").where("model_id = 'hash64-v1' and vec is not null").orderBy("vec_id").select("vec").first()
    return _long(search.retrieve(_memory(spark, sf), REQUEST, 10, vectors=_vectors(spark, sf), query_vector=list(v[0]) if v else None), "rank")


_MEMORY = f"""(SELECT 't' || turn_id AS doc_id, 'agent_turn' AS source_type, session_title AS title, concat_ws(chr(10), question, answer) AS text, question FROM ({_T})
 UNION ALL SELECT 'd' || doc_id, source_type, title, text, NULL FROM ({_D}))"""
RETRIEVE = _collapse_sql(
    f"""
SELECT doc_id, row_number() OVER (ORDER BY rank + CASE WHEN source_type <> 'agent_turn' OR works THEN 0 ELSE 8 END, rank)::BIGINT AS rank,
       CASE WHEN source_type = 'agent_turn' THEN {_WORDS.format("coalesce(nullif(question, ''), nullif(title, ''), text)")} ELSE [] END AS w
FROM (SELECT doc_id, row_number() OVER (ORDER BY round(score, 12) DESC, seen) AS rank
      FROM (SELECT doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(l * 1000000 + rank) AS seen
            FROM (SELECT doc_id, 0 AS l, rank FROM ({_lexical_sql(REQUEST, 60, corpus=_MEMORY)})
                  UNION ALL SELECT doc_id, 1, row_number() OVER (ORDER BY score DESC, doc_id) AS rank
                  FROM (SELECT 'd' || doc_id AS doc_id, list_dot_product(v::DOUBLE[], q) / (sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[])) * sqrt(list_dot_product(q, q)) + 1e-9) AS score
                        FROM (SELECT doc_id, arg_min(vec, vec_id) AS v FROM vectors WHERE model_id = 'hash64-v1' AND vec IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
                             (SELECT arg_min(vec, vec_id)::DOUBLE[] AS q FROM vectors WHERE model_id = 'hash64-v1' AND vec IS NOT NULL)
                        WHERE doc_id IN (SELECT doc_id FROM documents)) QUALIFY rank <= 60)
            GROUP BY doc_id) QUALIFY rank <= 30)
JOIN {_MEMORY} USING (doc_id) LEFT JOIN (SELECT 't' || turn_id AS doc_id, works FROM ({WORK_SIGNAL})) USING (doc_id)""",
    "SELECT doc_id, row_number() OVER (ORDER BY rank)::BIGINT AS rank FROM t WHERE list_contains((SELECT kept FROM z), t.rank) QUALIFY rank <= 10",
)


# -- maintenance ------------------------------------------------------------------------------------------------
def recent(spark: SparkSession, sf: str) -> DataFrame:
    t = _turns(spark, sf).select(F.col("turn_id").alias("id"), F.col("t").alias("ts"), "repo")
    newest = search.recent(t, 50)
    return _long(newest.select("id", "ts", F.row_number().over(Window.orderBy("ts", F.desc("id"))).alias("place")), "place")


RECENT = f"""
SELECT id, ts, row_number() OVER (ORDER BY ts, id DESC)::BIGINT AS place FROM (SELECT turn_id AS id, epoch_us(when_ts) AS ts FROM ({_T}) ORDER BY when_ts DESC NULLS LAST, turn_id LIMIT 50)
"""


def since_filter(spark: SparkSession, sf: str) -> DataFrame:
    t = _turns(spark, sf).withColumn("ts", F.col("when_ts").cast("timestamp"))
    return search.in_scope(t, since=F.to_timestamp(F.lit("2026-06-01 00:00:00"))).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


SINCE_FILTER = f"SELECT repo, count(*) AS n FROM ({_T}) WHERE epoch_us(when_ts) >= 1780272000000000 GROUP BY repo"


def stats_by_dimension(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select("source_type", "repo", F.lit(None).cast("string").alias("agent"))
    turns = _turns(spark, sf).select(F.lit("agent_turn").alias("source_type"), "repo", "agent")
    return search.stats(docs.unionAll(turns))


STATS = f"""
WITH d AS (SELECT source_type, repo, NULL AS agent FROM ({_D}) UNION ALL SELECT 'agent_turn', repo, agent FROM ({_T}))
SELECT 'total' AS dimension, '' AS value, count(*) AS n FROM d UNION ALL SELECT 'source_type', coalesce(source_type, ''), count(*) FROM d GROUP BY source_type
UNION ALL SELECT 'repo', coalesce(repo, ''), count(*) FROM d GROUP BY repo UNION ALL SELECT 'agent', agent, count(*) FROM d WHERE source_type = 'agent_turn' AND agent IS NOT NULL GROUP BY agent
"""


def distinct_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where("source_type = 'code'").select("repo", "path").distinct()


def get_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.col("doc_id") == 17).select("doc_id", "id", "repo", "title")


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All documents as an index has them, and a later pass over the code, in which every file has changed."""
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), F.lit(1).cast("long").alias("version"))
    code = d.join(_docs(spark, sf).where("source_type = 'code'").select("doc_id"), "doc_id", "left_semi")
    return d, code.withColumns({"digest": F.reverse("digest"), "version": F.lit(2).cast("long")})


def upsert_last_writer(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _versions(spark, sf)
    return store.last_writer(old, new.unionAll(new.withColumn("version", F.lit(1).cast("long"))), "doc_id")


_OLD = "SELECT doc_id, md5(coalesce(text, '')) AS digest, 1::BIGINT AS version FROM documents"
UPSERT = f"""
WITH d AS ({_OLD}), n AS (SELECT doc_id, reverse(digest) AS digest, 2::BIGINT AS version FROM d WHERE doc_id IN (SELECT doc_id FROM ({_D}) WHERE source_type = 'code'))
SELECT * FROM n UNION ALL SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM n)
"""


def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _versions(spark, sf)
    gone = store.stale(old, new, "doc_id").select("doc_id", F.lit("stale").alias("state"))
    return store.changed(old, new, "doc_id", "digest").select("doc_id", F.lit("changed").alias("state")).unionAll(gone)


MANIFEST = f"""
WITH o AS ({_OLD}), n AS (SELECT doc_id, reverse(digest) AS digest FROM o WHERE doc_id IN (SELECT doc_id FROM ({_D}) WHERE source_type = 'code'))
SELECT n.doc_id, 'changed' AS state FROM n LEFT JOIN o USING (doc_id) WHERE o.digest IS NULL OR o.digest <> n.digest
UNION ALL SELECT o.doc_id, 'stale' FROM o LEFT JOIN n USING (doc_id) WHERE n.doc_id IS NULL
"""


def forget_repo(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    biggest = d.where("repo is not null").groupBy("repo").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "repo").limit(1).select("repo")
    return d.join(biggest, "repo", "left_anti").groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


FORGET = f"""
WITH b AS (SELECT repo FROM documents WHERE repo IS NOT NULL GROUP BY repo ORDER BY count(*) DESC, repo LIMIT 1)
SELECT source_type, count(*) AS n FROM ({_D}) WHERE repo IS NULL OR repo NOT IN (SELECT repo FROM b) GROUP BY source_type
"""


def citation(spark: SparkSession, sf: str) -> DataFrame:
    from .render import citation as cite

    t = _turns(spark, sf).select(
        "turn_id", F.lit("agent_turn").alias("source_type"), "repo", F.lit("").alias("path"), X.turn_title(F.col("session_title"), F.col("question")).alias("title"),
        F.col("when_ts").cast("timestamp").alias("ts"), "agent", "session_title",
    )
    return t.select("turn_id", cite().alias("citation"))


CITATION = f"""
SELECT turn_id, repo || ' ' || coalesce(strftime(make_timestamp(epoch_us(when_ts)), '%Y-%m-%d'), '?') || ' ' || CASE WHEN agent IS NOT NULL AND agent <> 'claude' THEN '[' || agent || '] ' ELSE '' END || 'session:' ||
       CASE WHEN coalesce(session_title, '') <> '' THEN session_title ELSE substr(coalesce(({_LINES.format("question")})[1], ''), 1, 80) END AS citation
FROM ({_T})
"""

QUERIES = {
    f.__name__: f
    for f in (
        doc_normalize, redact_all, redact_entropy, redact_high, clean_blocks, turn_documents, turns_claude, turns_codex, turns_gemini, link_commits, work_signal, chunk_windows,
        chunk_symbols, token_counts, corpus_stats, lexical_topk, lexical_filtered, lexical_prefix, lexical_phrase, vector_topk, vector_filtered, vector_dim_mismatch,
        hybrid_topk, rerank, dedup, retrieve_full, recent, since_filter, stats_by_dimension, distinct_paths, get_by_id, upsert_last_writer, manifest_diff, forget_repo, citation,
    )
}
SQL = {
    "doc_normalize": DOC_NORMALIZE, "redact_all": _redact_sql(), "redact_entropy": REDACT_ENTROPY, "redact_high": _redact_high_sql(), "clean_blocks": CLEAN_BLOCKS, "turn_documents": TURN_DOCUMENTS,
    "turns_claude": _turns_sql("claude"), "turns_codex": _turns_sql("codex"), "turns_gemini": _turns_sql("gemini"), "link_commits": LINK_COMMITS, "work_signal": WORK_SIGNAL,
    "chunk_windows": CHUNK_WINDOWS, "chunk_symbols": _chunk_sql(), "token_counts": TOKEN_COUNTS, "corpus_stats": CORPUS_STATS, "lexical_topk": _lexical_sql(QUERY, 50),
    "lexical_filtered": _lexical_sql(QUERY, 20, "source_type = 'note'"), "lexical_prefix": _lexical_sql(PREFIX_QUERY, 30), "lexical_phrase": _lexical_sql(PHRASE_QUERY, 30),
    "vector_topk": _vector_sql(20), "vector_filtered": _vector_sql(10, "label >= 5"),
    "vector_dim_mismatch": "SELECT vec_id AS doc_id, 0.0::DOUBLE AS score, 0::BIGINT AS rank FROM embeddings WHERE false",
    "hybrid_topk": HYBRID_TOPK, "rerank": RERANK, "dedup": DEDUP, "retrieve_full": RETRIEVE, "recent": RECENT, "since_filter": SINCE_FILTER, "stats_by_dimension": STATS,
    "distinct_paths": f"SELECT DISTINCT repo, path FROM ({_D}) WHERE source_type = 'code'", "get_by_id": "SELECT doc_id, id, repo, title FROM documents WHERE doc_id = 17",
    "upsert_last_writer": UPSERT, "manifest_diff": MANIFEST, "forget_repo": FORGET, "citation": CITATION,
}
