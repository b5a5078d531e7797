"""Turns linked to the commits they led to: an interval join on directory and time with best-of selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename

WINDOW_MIN = 180
MINUTE = 60_000_000


def link_commits(turns: DataFrame, commits: DataFrame, window_min: int = WINDOW_MIN) -> DataFrame:
    """(turn_id, rank, short_sha, subject, kind): commits of the same cwd at most ``window_min`` after the turn.

    ``turns``: (turn_id, cwd, t, files); ``commits``: (cwd, t, short_sha, subject, files), t in microseconds. If commits
    share file names with the turn, the three with most in common count (kind ``file``, ties: sooner, then sha);
    otherwise the soonest that has files, or the soonest of all (kind ``time``). NULL or blank cwd and NULL times link
    nothing; repeated rows count once; other columns are dropped.

    Both sides meet in buckets of the window's length, a turn in its own and the next, so a hot directory is spread
    over its time and no directory is paired as a whole.
    """
    width = window_min * MINUTE
    names = lambda c: F.array_distinct(F.transform(F.coalesce(F.col(c), F.array()), basename))
    bucket = F.floor(F.col("t") / F.lit(width)).cast("long")
    usable = "cwd is not null and trim(cwd) <> '' and t is not null"
    left = turns.where(usable).select("turn_id", "cwd", "t", names("files").alias("touched")).dropDuplicates(["turn_id"])
    left = left.withColumn("bucket", F.explode(F.array(bucket, bucket + 1)))
    right = commits.where(usable).select("cwd", F.col("t").alias("ct"), "short_sha", "subject", names("files").alias("changed"), bucket.alias("bucket"))
    right = right.dropDuplicates(["cwd", "short_sha"])
    near = left.join(right, ["cwd", "bucket"]).where((F.col("ct") >= F.col("t")) & (F.col("ct") <= F.col("t") + width))
    near = near.select(
        "turn_id", "short_sha", "subject", (F.col("ct") - F.col("t")).alias("delay"),
        F.size(F.array_intersect("touched", "changed")).alias("common"), (F.size("changed") > 0).alias("listed"),
    )
    by = Window.partitionBy("turn_id").orderBy(F.desc("common"), F.desc("listed"), "delay", "short_sha")
    ranked = near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= 3)
    ranked = ranked.where((F.col("common") > 0) | (F.col("rank") == 1))
    kind = F.when(F.col("common") > 0, F.lit("file")).otherwise(F.lit("time"))
    return ranked.select("turn_id", "rank", "short_sha", "subject", kind.alias("kind"))
