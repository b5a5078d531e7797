"""Problem 5 as a query: every timestamp of the message log and of the documents as one instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instants import CANONICAL, ZONE_ABBREVIATIONS, with_instant
from ..session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_id, utc_us) of every value that denotes an instant and is not already in the canonical form.

    NULLs, blanks, text that is no time and local times that do not exist give no row; repeated rows count once.
    """
    machines = table(spark, sf_dir, "machines")

    def of(src: str, name: str, key: str, value: str) -> DataFrame:
        rows = table(spark, sf_dir, name).select(F.col(key).alias("row_id"), "machine", F.col(value).alias("value"))
        rows = rows.where(F.col("row_id").isNotNull() & F.col("value").isNotNull() & ~F.col("value").rlike(CANONICAL))
        found = with_instant(rows, machines, "value").where(F.col("utc_us").isNotNull())
        return found.select(F.lit(src).alias("src"), "row_id", "utc_us")

    return of("message", "message_records", "rec_id", "timestamp").unionAll(of("doc", "documents", "doc_id", "ts")).distinct()


# Formats as DuckDB reads them, after the zone is cut off and halves of the day are in English.
_FORMATS = (
    "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y%m%dT%H%M%S", "%a, %d %b %Y %H:%M:%S", "%a %b %d %H:%M:%S %Y",
    "%d.%m.%Y %H:%M", "%b %d, %Y %I:%M:%S %p", "%Y-%m-%d %I:%M:%S %p",
)
_LIST = ", ".join(f"'{f}'" for f in _FORMATS)
_ZONES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in ZONE_ABBREVIATIONS.items())
INSTANTS_SQL = rf"""
SELECT src, row_id, us FROM (
  SELECT src, row_id, CASE
    WHEN regexp_full_match(s, '\d{{10}}(\.\d+)?( [+-]\d{{4}})?') THEN (split_part(s, ' ', 1)::DECIMAL(24, 9) * 1000000)::DECIMAL(24, 6)::BIGINT
    WHEN regexp_full_match(s, '\d{{13}}') THEN s::BIGINT * 1000
    WHEN regexp_full_match(s, '\d{{16}}') THEN s::BIGINT
    WHEN zone <> '' THEN epoch_us(local) - CASE WHEN zone ~ '^[+-]' THEN (CASE WHEN zone[1] = '-' THEN -1 ELSE 1 END) * (zone[2:3]::INT * 60 + right(zone, 2)::INT) ELSE CASE upper(zone) {_ZONES} END END * 60000000::BIGINT
    WHEN timezone(tz, timezone(tz, local)) = local THEN epoch_us(CASE WHEN timezone(tz, timezone(tz, local) - INTERVAL 1 HOUR) = local THEN timezone(tz, local) - INTERVAL 1 HOUR ELSE timezone(tz, local) END)
    END AS us
  FROM (SELECT *, CASE WHEN contains(x, '/') AND o = 'mdy' THEN try_strptime(x, ['%m/%d/%Y %I:%M:%S %p', '%m/%d/%Y %H:%M:%S']) WHEN contains(x, '/') THEN try_strptime(x, ['%d/%m/%Y %I:%M:%S %p', '%d/%m/%Y %H:%M:%S']) ELSE try_strptime(x, [{_LIST}]) END AS local
    FROM (SELECT *, regexp_extract(t, '(?i)(Z|[+-]\d{{2}}:?\d{{2}}| [A-Z]{{3,4}})$') AS z0, trim(z0) AS zone, trim(t[1:length(t) - length(z0)]) AS x
      FROM (SELECT src, row_id, s, coalesce(tz, 'UTC') AS tz, coalesce(date_order, 'dmy') AS o,
          regexp_replace(regexp_replace(regexp_replace(upper(regexp_replace(regexp_replace(s, '\s+', ' ', 'g'), '\[.*\]$', '')), '(\d),(\d{{3}})$', '\1.\2'), '(\.\d{{6}})\d+', '\1'),
            '^(\d+)년 (\d+)월 (\d+)일 (오전|오후) (.*)$', CASE WHEN contains(s, '오전') THEN '\1-\2-\3 \5 AM' ELSE '\1-\2-\3 \5 PM' END) AS t
        FROM (SELECT 'message' AS src, rec_id AS row_id, trim(timestamp) AS s, machine FROM message_records WHERE NOT regexp_full_match(timestamp, '\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}}Z')
              UNION ALL SELECT 'doc', doc_id, trim(ts), machine FROM documents WHERE NOT regexp_full_match(ts, '\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}}Z')) LEFT JOIN machines USING (machine)))))
WHERE us IS NOT NULL
"""

QUERIES = {"p5_found": p5_found}
SQL = {"p5_found": f"SELECT DISTINCT src, row_id, us AS utc_us FROM ({INSTANTS_SQL})"}
