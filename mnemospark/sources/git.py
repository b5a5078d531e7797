"""Git repositories: tracked files, commit logs and patches, read by the driver or by one task per repository."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import make_id

_RECORD, _FIELD = "\x1e", "\x1f"


def _git(repo: str, *args: str, seconds: int = 60) -> str | None:
    """The output of a git command, None if it fails or takes too long."""
    try:
        out = subprocess.run(["git", "-C", repo, *args], capture_output=True, timeout=seconds)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return out.stdout.decode("utf-8", "replace") if out.returncode == 0 else None


def tracked_files(repo: str) -> list[str]:
    """The relative paths that git tracks; none outside a repository."""
    return [p for p in (_git(repo, "ls-files", "-z", seconds=30) or "").split("\0") if p]


def head(repo: str) -> str | None:
    return (_git(repo, "rev-parse", "HEAD", seconds=10) or "").strip() or None


def repo_name(path: str = ".", inside_only: bool = False) -> str | None:
    """The name of the repository that holds ``path``; outside one None, or the folder's name unless ``inside_only``."""
    top = (_git(path, "rev-parse", "--show-toplevel", seconds=5) or "").strip()
    return os.path.basename(top) if top else None if inside_only else os.path.basename(os.path.realpath(path))


def patch(repo: str, sha: str, most: int = 40) -> str | None:
    """Summary and patch of a commit, cut after ``most`` lines with a note on how many are missing."""
    shown = (_git(repo, "show", sha, "--stat", "--patch", "--format=", seconds=15) or "").strip().splitlines()
    if not shown:
        return None
    return "\n".join(shown if len(shown) <= most else [*shown[:most], f"... (+{len(shown) - most} more lines truncated)"])


class _Repo(InputPartition):
    def __init__(self, repo: str):
        self.repo = repo


class _LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repos = [r for r in options["repos"].split("\n") if r]
        self.everything, self.since = options.get("all", "false") == "true", options.get("since", "")

    def partitions(self) -> list[InputPartition]:
        return [_Repo(r) for r in self.repos] or [_Repo("")]

    def read(self, partition: _Repo) -> Iterator[tuple]:
        if not partition.repo or (self.everything and not os.path.exists(os.path.join(partition.repo, ".git"))):
            return
        args = ["log", "--name-only", f"--pretty=format:{_RECORD}%H{_FIELD}%cI{_FIELD}%s"]
        if self.everything:
            args.append("--all")
        out = _git(partition.repo, *args, f"{self.since}..HEAD") if self.since else None
        out = out if out is not None else _git(partition.repo, *args)  # the last indexed commit may be gone
        for record in (out or "").split(_RECORD)[1:]:
            header, _, rest = record.partition("\n")
            fields = header.split(_FIELD)
            if len(fields) >= 3:
                yield partition.repo, fields[0], fields[1], fields[2], [f.strip() for f in rest.split("\n") if f.strip()]


class GitLog(DataSource):
    """``spark.read.format("gitlog").option("repos", "/a\\n/b")``, one task per repository."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return "cwd string, full_sha string, committed string, subject string, files array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options)


def commit_log(spark: SparkSession, repos: list[str], all_branches: bool = False, since: str = "") -> DataFrame:
    """(cwd, full_sha, short_sha, committed_at, subject, files) of the commits of HEAD or all branches, after ``since`` if it is known."""
    spark.dataSource.register(GitLog)
    log = spark.read.format("gitlog").options(repos="\n".join(repos), all=str(all_branches).lower(), since=since).load()
    return log.select("cwd", "full_sha", F.substring("full_sha", 1, 9).alias("short_sha"), F.try_to_timestamp("committed").alias("committed_at"), "subject", "files")


def commit_documents(log: DataFrame, repo: str) -> DataFrame:
    """Commit documents: the subject and the changed files as text, an unreadable date as NULL."""
    body = F.array_join(F.concat(F.array("subject"), "files"), "\n")
    return log.select(
        make_id("commit", F.lit(repo), F.col("full_sha")).alias("id"), F.lit("commit").alias("source_type"), F.lit(repo).alias("repo"), F.col("short_sha").alias("path"),
        F.col("subject").alias("title"), body.alias("text"), F.col("committed_at").alias("ts"), F.col("short_sha").alias("sha"), "full_sha", "files", F.col("cwd").alias("root"),
    )
