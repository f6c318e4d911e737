"""Commit history as a Spark data source: ``spark.read.format("gitlog").load(path)``.

Batch reads split the history into partitions of 100 commits, each read by its own ``git show``; streaming
reads continue behind the commits already seen. Messages and names are delimited by NUL characters, so any
text survives; merge commits are compared with their first parent.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

BATCH = 100
SCHEMA = (
    "seq bigint, id string, repo string, parents array<string>, timestamp string, author_name string, author_email string, committer_date string, committer_name string, "
    "committer_email string, message string, diffs array<struct<a_path string, b_path string, change_type string, b_blob_sha string, patch string>>"
)
FORMAT = "%x1e%H%x00%P%x00%aI%x00%an%x00%ae%x00%cI%x00%cn%x00%ce%x00%B%x00"
_RECORD = re.compile(r"\x1e(?=[0-9a-f]{40,64}\x00)")
_NOTHING = re.compile("^0+$")


def _git(path: str, *args: str, data: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-c", "core.quotePath=false", "-C", path, *args], input=data, capture_output=True, check=False).stdout


def commit_ids(path: str) -> list[str]:
    """All commits of HEAD, parents before children; empty if there are none."""
    return _git(path, "rev-list", "--topo-order", "--reverse", "HEAD").decode().split()


def acquire(source: str, cache: str, token: str = "") -> str:
    """The local path of a repository: itself if it is a folder, else a clone under ``cache`` that is pulled when it exists.

    A token is put into an https address for the transfer only. What can't be fetched raises ``ValueError``.
    """
    if os.path.isdir(source):
        return source
    name = re.sub(r"\.git$", "", source.rstrip("/")).replace(":", "/").rsplit("/", 1)[-1]
    if not name or not re.match(r"(?:https?|ssh|git|file)://|[\w.-]+@", source):
        raise ValueError(f"{source!r} is neither a folder nor an address")
    at, path = re.sub(r"^(https?://)(?:[^@/]*@)?", rf"\1{token}@", source) if token else source, os.path.join(cache, name)
    if os.path.isdir(path):
        done = subprocess.run(["git", "-C", path, "pull", "-q", "--ff-only", at], capture_output=True, check=False)
    else:
        os.makedirs(cache, exist_ok=True)
        done = subprocess.run(["git", "clone", "-q", at, path], capture_output=True, check=False)
        if done.returncode == 0 and token:
            subprocess.run(["git", "-C", path, "remote", "set-url", "origin", source], capture_output=True, check=False)
    if done.returncode:
        raise ValueError(f"cannot fetch {source!r}")
    return path


def remotes(path: str) -> list[str]:
    """The distinct remote URLs."""
    return list(dict.fromkeys(line.split()[1] for line in _git(path, "remote", "-v").decode().splitlines() if len(line.split()) > 1))


def _diffs(text: str) -> list[tuple]:
    """(a_path, b_path, change_type, b_blob_sha, patch) of the raw lines and patches of one commit."""
    out, segments, raw = [], re.split(r"(?m)^(?=diff --git )", text), []
    for line in segments[0].splitlines():
        if line.startswith(":"):
            meta, *paths = line.split("\t")
            fields = meta.split()
            if len(fields) >= 5 and paths:
                raw.append((fields[4], fields[3], paths))
    patches = {}
    for segment in segments[1:]:
        new = re.search(r"(?m)^(?:\+\+\+ b/|rename to |copy to )(.*)$", segment) or re.search(r"(?m)^--- a/(.*)$", segment) or re.match(r"diff --git a/.* b/(.*)", segment)
        if new:
            patches.setdefault(new[1].rstrip("\t"), []).append(segment)
    for status, blob, paths in raw:
        a, b = paths[0], None if status[0] == "D" else paths[-1]
        out.append((a, b, status, None if _NOTHING.match(blob) else blob, "".join(patches.get(b or a, []))))
    return out


def read_commits(path: str, ids: list[str], first: int) -> Iterator[tuple]:
    """Rows of SCHEMA for the given commits, numbered from ``first``."""
    repo = os.path.basename(os.path.abspath(path))
    shown = _git(path, "show", "--no-abbrev", "--raw", "-p", "-U0", "-M", "--diff-merges=first-parent", f"--format={FORMAT}", "--stdin", data="\n".join(ids).encode())
    at = {sha: i for i, sha in enumerate(ids)}
    for record in _RECORD.split(shown.decode("utf-8", "replace"))[1:]:
        sha, parents, *names, message, rest = record.split("\x00", 9)
        date, author, mail, committed, committer, committer_mail = names
        yield (first + at[sha], sha, repo, parents.split(), date, author, mail, committed, committer, committer_mail, message.rstrip("\n"), _diffs(rest.lstrip("\n")))


class _Batch(InputPartition):
    def __init__(self, first: int, ids: list[str]) -> None:
        self.first, self.ids = first, ids


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("batch", BATCH))

    def partitions(self) -> list[_Batch]:
        ids = commit_ids(self.path)
        return [_Batch(a, ids[a : a + self.size]) for a in range(0, len(ids), self.size)] or [_Batch(0, [])]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        if partition.ids:
            yield from read_commits(self.path, partition.ids, partition.first)


class _Stream(DataSourceStreamReader):
    """Offsets are numbers of commits; a micro-batch is read in partitions like a batch."""

    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("batch", BATCH))

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's names
        return {"commits": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"commits": len(commit_ids(self.path))}

    def partitions(self, start: dict, end: dict) -> list[_Batch]:
        ids = commit_ids(self.path)[start["commits"] : end["commits"]]
        return [_Batch(start["commits"] + a, ids[a : a + self.size]) for a in range(0, len(ids), self.size)] or [_Batch(0, [])]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        if partition.ids:
            yield from read_commits(self.path, partition.ids, partition.first)

    def commit(self, end: dict) -> None:
        """Nothing to forget: the repository keeps its commits."""


class GitLog(DataSource):
    """Options: path (``load``'s argument), batch (commits per partition)."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _Stream:  # noqa: N802
        return _Stream(self.options)


def history(spark: SparkSession, path: str, batch: int = BATCH) -> DataFrame:
    """The commits of a local repository."""
    spark.dataSource.register(GitLog)
    return spark.read.format("gitlog").option("batch", batch).load(path)


def histories(spark: SparkSession, paths: str) -> DataFrame:
    """The commits of a comma-separated list of repositories."""
    out = None
    for p in filter(None, (x.strip() for x in paths.split(","))):
        one = history(spark, p)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def changes(commits: DataFrame) -> DataFrame:
    """(commit_id, seq, repo, a_path, b_path, change_type, b_blob_sha, patch): one row per changed file."""
    return commits.select(F.col("id").alias("commit_id"), "seq", "repo", F.explode("diffs").alias("d")).select("commit_id", "seq", "repo", "d.*")


def blobs(shas: DataFrame, path: str) -> DataFrame:
    """(b_blob_sha, content) of the distinct blob ids, decoded as UTF-8 with replacement; unknown ids have no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, names = [], frame["b_blob_sha"].tolist()
            data = _git(path, "cat-file", "--batch", data="\n".join(names).encode() + b"\n") if names else b""
            at = 0
            while at < len(data):
                end = data.index(b"\n", at)
                head = data[at:end].split()
                at = end + 1
                if len(head) == 3 and head[1] == b"blob":
                    size = int(head[2])
                    out.append((head[0].decode(), data[at : at + size].decode("utf-8", "replace")))
                    at += size + 1
                elif len(head) == 3:
                    at += int(head[2]) + 1
            yield pd.DataFrame(out, columns=["b_blob_sha", "content"])

    return shas.select("b_blob_sha").where("b_blob_sha IS NOT NULL").distinct().mapInPandas(run, "b_blob_sha string, content string")
