"""Problem 4: records of two tables paired by nearest time for the same entity, by tick expansion.

Right records are exploded to every tick within the tolerance and only the nearest per entity and tick is kept;
left records then find their partner by equi-joins on (entity, tick). A tick is coarser than the times, so what
lies inside a left record's own tick is resolved on a second level: first and last record of each second of the
tick, and the distinct times of the left record's own second. No step pairs all records of an entity: the rows of
a tick are bounded by its seconds, and a hot entity spreads over its ticks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instants import with_instant
from ..plans.times import INSTANTS_SQL
from ..session import table

SECOND = 1_000_000
MINUTE = 60 * SECOND


def nearest_in_time(left: DataFrame, right: DataFrame, *, back_us: int, forward_us: int, tick_us: int) -> DataFrame:
    """(lid, entity, t, key, right_t): the right record nearest to each left record, at most one each.

    ``left``: (lid, entity, t), ``right``: (entity, t, key), times in microseconds. A partner lies at most
    ``back_us`` before and ``forward_us`` after the left record, both inclusive. Of equally near partners the
    earlier counts, then the smaller key. Rows with a NULL in any of these columns and lefts without a partner give
    no row; repeated lefts each give one; other columns are dropped. ``tick_us`` is a whole number of seconds.
    """
    tick = lambda c: F.floor(c / F.lit(tick_us)).cast("long")
    second = lambda c: F.floor(c / F.lit(SECOND)).cast("long")
    left = left.select("lid", "entity", "t").dropna()
    r = right.select("entity", "t", "key").dropna().groupBy("entity", "t").agg(F.min("key").alias("key"))
    one = F.struct("t", "key")
    seconds = r.groupBy("entity", second(F.col("t")).alias("sec")).agg(
        F.min(one).alias("first"), F.max(one).alias("last"), F.collect_list(one).alias("own")
    )
    ends = F.struct(F.col("sec"), F.col("first"), F.col("last"))
    ticks = seconds.groupBy("entity", tick(F.col("sec") * SECOND).alias("tick")).agg(
        F.collect_list(ends).alias("seconds"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    reach = lambda us: -(-us // tick_us)
    offset = F.explode(F.sequence(F.lit(-reach(forward_us)), F.lit(reach(back_us)))).alias("off")
    spread = ticks.select("entity", "tick", "first", "last", "seconds", offset)
    at = F.col("off")
    near = spread.groupBy("entity", (F.col("tick") + at).alias("tick")).agg(
        F.min(F.when(at < 0, F.col("first"))).alias("after"),
        F.max(F.when(at > 0, F.col("last"))).alias("before"),
        F.first(F.when(at == 0, F.col("seconds")), ignorenulls=True).alias("seconds"),
    )

    def better(c: Column, kind: str) -> Column:
        return F.struct(F.abs(c["t"] - F.col("t")).alias("gap"), c["t"].alias("t"), c["key"].alias("key")) if kind else c

    def allowed(c: Column) -> Column:
        gap = c["t"] - F.col("t")
        return F.when(c.isNotNull() & (gap >= -back_us) & (gap <= forward_us), better(c, "gap"))

    probe = left.withColumns({"tick": tick(F.col("t")), "sec": second(F.col("t"))})
    probe = probe.join(near, ["entity", "tick"], "left")
    probe = probe.join(seconds.select("entity", "sec", "own"), ["entity", "sec"], "left")
    others = F.filter(F.coalesce(F.col("seconds"), F.array()), lambda s: s["sec"] != F.col("sec"))
    best = F.least(
        allowed(F.col("after")),
        allowed(F.col("before")),
        F.array_min(F.transform(others, lambda s: F.least(allowed(s["first"]), allowed(s["last"])))),
        F.array_min(F.transform(F.coalesce(F.col("own"), F.array()), allowed)),
    )
    found = probe.select("lid", "entity", "t", best.alias("best")).where("best is not null")
    return found.select("lid", "entity", "t", F.col("best.key").alias("key"), F.col("best.t").alias("right_t"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(turn_id, kind, target_key): the first commit after each turn and the note nearest to it, in its directory."""
    named = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c)) != "")
    turns = table(spark, sf_dir, "turns").where(F.col("when_ts").isNotNull() & F.col("turn_id").isNotNull() & named("cwd"))
    left = turns.groupBy(F.col("turn_id").alias("lid")).agg(F.min(F.struct(F.unix_micros(F.col("when_ts").cast("timestamp")).alias("t"), "cwd")).alias("x"))
    left = left.select("lid", F.col("x.cwd").alias("entity"), F.col("x.t").alias("t"))
    commits = table(spark, sf_dir, "commit_log").where(named("cwd")).select(
        F.col("cwd").alias("entity"), F.unix_micros(F.col("committed_at").cast("timestamp")).alias("t"), F.col("full_sha").alias("key")
    )
    notes = table(spark, sf_dir, "documents").where((F.lower(F.trim("source")) == "note") & named("cwd") & F.col("ts").isNotNull())
    notes = with_instant(notes.select("doc_id", "cwd", "ts", "machine"), table(spark, sf_dir, "machines"), "ts", "t")
    notes = notes.select(F.col("cwd").alias("entity"), "t", F.col("doc_id").alias("key"))
    first = nearest_in_time(left, commits, back_us=0, forward_us=180 * MINUTE, tick_us=15 * MINUTE)
    beside = nearest_in_time(left, notes, back_us=45 * MINUTE, forward_us=45 * MINUTE, tick_us=5 * MINUTE)
    out = lambda d, kind: d.select(F.col("lid").alias("turn_id"), F.lit(kind).alias("kind"), F.col("key").cast("string").alias("target_key"))
    return out(first, "commit").unionAll(out(beside, "note"))


QUERIES = {"p4_found": p4_found}
SQL = {
    "p4_found": f"""
WITH l AS (SELECT turn_id, min(epoch_us(when_ts)) AS t, min(cwd) AS cwd FROM turns WHERE when_ts IS NOT NULL AND trim(cwd) <> '' GROUP BY turn_id),
     c AS (SELECT l.turn_id, row_number() OVER (PARTITION BY l.turn_id ORDER BY epoch_us(c.committed_at), c.full_sha) AS r, c.full_sha AS k
           FROM l JOIN commit_log c ON c.cwd = l.cwd AND epoch_us(c.committed_at) BETWEEN l.t AND l.t + {180 * MINUTE}),
     n AS (SELECT doc_id, cwd, us FROM documents JOIN ({INSTANTS_SQL}) i ON i.src = 'doc' AND i.row_id = doc_id WHERE lower(trim(source)) = 'note'
           UNION ALL SELECT doc_id, cwd, epoch_us(try_strptime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')) FROM documents WHERE lower(trim(source)) = 'note' AND regexp_full_match(ts, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}\\.\\d{{3}}Z')),
     d AS (SELECT l.turn_id, row_number() OVER (PARTITION BY l.turn_id ORDER BY abs(n.us - l.t), n.us, n.doc_id) AS r, n.doc_id AS k
           FROM l JOIN n ON n.cwd = l.cwd AND n.us BETWEEN l.t - {45 * MINUTE} AND l.t + {45 * MINUTE})
SELECT turn_id, 'commit' AS kind, k AS target_key FROM c WHERE r = 1 UNION ALL SELECT turn_id, 'note', k::VARCHAR FROM d WHERE r = 1
"""
}
