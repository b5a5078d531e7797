"""Files of any name as rows: a Python data source over a manifest, ignore patterns and session logs.

Spark's own file sources leave out names that start with ``.`` or ``_``; this one reads what the manifest lists. Paths
are those of a file system that all executors see.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import strip

BATCH = 256
FILE = "path string, size long, mtime double, sha1 string, content binary"


class _Batch(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.patterns, self.opened = options["root"], options.get("patterns", "*").split("|"), options.get("contents", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        found = []
        for folder, folders, names in os.walk(self.root):
            folders.sort()
            for n in names:
                rel = os.path.relpath(os.path.join(folder, n), self.root)
                if any(fnmatch.fnmatchcase(rel, p) or fnmatch.fnmatchcase(n, p) for p in self.patterns):
                    found.append(rel)
        found.sort()
        return [_Batch(found[k : k + BATCH]) for k in range(0, len(found), BATCH)] or [_Batch([])]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        for rel in partition.paths:
            row = _file(self.root, rel, self.opened)
            if row:
                yield row


def _file(root: str, rel: str, opened: bool) -> tuple | None:
    """(path, size, mtime, sha1, content) of a file, the last two None if it isn't to be opened; None if it can't be read."""
    path = os.path.join(root, rel)
    try:
        s = os.stat(path)
        if not opened:
            return rel, s.st_size, s.st_mtime, None, None
        with open(path, "rb") as f:
            data = f.read()
    except OSError:
        return None
    return rel, s.st_size, s.st_mtime, hashlib.sha1(data).hexdigest(), data


class RawFiles(DataSource):
    """``spark.read.format("rawfiles").option("root", folder).option("patterns", "*.jsonl|x/*.md")``; with the option
    ``contents`` ``false`` no file is opened."""

    @classmethod
    def name(cls) -> str:
        return "rawfiles"

    def schema(self) -> str:
        return FILE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def raw_files(spark: SparkSession, root: str, patterns: str = "*") -> DataFrame:
    """(path, size, mtime, sha1, content) of the files under ``root`` that match one of the ``|``-separated patterns, by
    relative path or name; unreadable files are left out, a missing folder gives no rows."""
    spark.dataSource.register(RawFiles)
    return spark.read.format("rawfiles").option("root", root).option("patterns", patterns).load()


def manifest(spark: SparkSession, root: str, patterns: str = "*") -> DataFrame:
    """(path, size, mtime) of the same files; none is opened."""
    spark.dataSource.register(RawFiles)
    return spark.read.format("rawfiles").option("root", root).option("patterns", patterns).option("contents", "false").load().select("path", "size", "mtime")


def read_files(paths: DataFrame, root: str) -> DataFrame:
    """The columns of ``raw_files`` for a table of paths (path) below ``root``; only these files are opened, by the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                row = _file(root, p, True)
                if row:
                    yield pd.DataFrame([row], columns=["path", "size", "mtime", "sha1", "content"])

    parts = max(1, -(-paths.count() // BATCH))
    return paths.select("path").repartition(parts).mapInPandas(run, FILE)


def text_of(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 is replaced."""
    return F.make_valid_utf8(content.cast("string"))


def numbered_lines(files: DataFrame) -> DataFrame:
    """(path, mtime, line, value) of text files (path, mtime, content): the lines that are not blank, numbered from 1."""
    each = F.posexplode(F.split(text_of(F.col("content")), "\n", -1)).alias("n", "value")
    return files.select("path", "mtime", each).where(F.col("value").rlike(r"(?U)\S")).select("path", "mtime", (F.col("n") + 1).alias("line"), "value")


def ignore_patterns(*texts: str) -> list[str]:
    """The patterns of ignore files, without comments and blank lines."""
    return [p for t in texts for line in t.splitlines() if (p := line.strip()) and not p.startswith("#")]


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path matches a pattern: a folder pattern (``x/``) from the root, others by the whole path, any
    of its ends after a ``/``, or the name. One regular expression for all patterns."""
    parts = []
    for p in patterns:
        if p.endswith("/"):
            parts.append(re.escape(p[:-1]) + r"(?:/.*)?")
        else:
            body = re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"\1", fnmatch.translate(p))
            parts.append(rf"(?:.*/)?(?:{body})")
    return path.rlike(r"(?s)\A(?:" + "|".join(parts) + r")\z") if parts else F.lit(False)


SESSION_FILES = {"claude": "*.jsonl", "codex": "rollout-*.jsonl", "gemini": "*/chats/*.jsonl"}


def session_records(spark: SparkSession, agent: str, root: str, paths: DataFrame | None = None) -> DataFrame:
    """Records (session_id, line, agent, type, content, timestamp, cwd, git_branch, is_meta, is_sidechain, toolCalls, path, mtime)
    of an agent's session logs under ``root``, or of those of ``paths`` alone; lines that are no JSON objects are dropped."""
    files = raw_files(spark, root, SESSION_FILES[agent]) if paths is None else read_files(paths, root)
    if agent == "gemini":  # exactly one folder, then chats: copies further down are no sessions
        files = files.where(F.size(F.split("path", "/")) == 3)
    r = numbered_lines(files).withColumn("v", F.try_parse_json("value")).where(F.schema_of_variant("v").startswith("OBJECT"))
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    stem = F.regexp_replace(F.regexp_extract("path", r"[^/]*$", 0), r"\.[^.]*$", "")
    null = F.lit(None).cast("string")
    if agent == "claude":
        cols = [
            F.coalesce(F.nullif(get("$.sessionId"), F.lit("")), stem), F.coalesce(get("$.message.content"), get("$.aiTitle")), get("$.timestamp"),
            F.coalesce(get("$.cwd"), F.lit("")), F.coalesce(get("$.gitBranch"), F.lit("")), get("$.isMeta", "boolean"), get("$.isSidechain", "boolean"), null,
        ]
    elif agent == "codex":
        from pyspark.sql import Window

        so_far = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
        meta = lambda *p: F.coalesce(*[F.when(get("$.type") == "session_meta", F.nullif(get(x), F.lit(""))) for x in p])
        r = r.withColumns(
            {"_cwd": F.last(meta("$.payload.cwd"), True).over(so_far), "_branch": F.last(meta("$.payload.git.branch", "$.payload.git_branch"), True).over(so_far)}
        )
        cols = [stem, get("$.payload"), get("$.timestamp"), F.coalesce("_cwd", F.lit("")), F.coalesce("_branch", F.lit("")), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), null]
    else:
        project = F.split_part(F.col("path"), F.lit("/"), F.lit(1))
        roots = raw_files(spark, root, "*/.project_root").select(F.split_part("path", F.lit("/"), F.lit(1)).alias("_p"), strip(text_of(F.col("content"))).alias("_root"))
        r = r.withColumn("_p", project).join(roots, "_p", "left").where(get("$.content").isNotNull())
        cols = [stem, get("$.content"), get("$.timestamp"), F.coalesce("_root", "_p"), F.lit(""), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), get("$.toolCalls")]
    names = ["session_id", "content", "timestamp", "cwd", "git_branch", "is_meta", "is_sidechain", "toolCalls"]
    return r.select(*[c.alias(n) for c, n in zip(cols, names, strict=True)], "line", F.lit(agent).alias("agent"), get("$.type").alias("type"), "path", "mtime")
