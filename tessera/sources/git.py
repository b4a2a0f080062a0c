"""Git objects as Spark data sources: a commit's files and a history's numstat lines, each read in parallel partitions."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout


class _Part(InputPartition):
    def __init__(self, value: list):
        self.value = value


def _cut(items: list, parts: int) -> list[_Part]:
    size = max(1, -(-len(items) // parts))
    return [_Part(items[k : k + size]) for k in range(0, len(items), size)] or [_Part([])]


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.ref, self.parts = options["path"], options.get("ref", "HEAD"), int(options.get("partitions", 8))

    def partitions(self) -> list[_Part]:
        entries = [e.split("\t", 1) for e in git(self.repo, "ls-tree", "-r", "-z", self.ref).decode().split("\0") if e]
        return _cut([(meta.split()[2], path) for meta, path in entries if meta.split()[0] in ("100644", "100755")], self.parts)

    def read(self, partition: _Part) -> Iterator[tuple]:
        with subprocess.Popen(["git", "-C", self.repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
            for sha, path in partition.value:
                p.stdin.write(f"{sha}\n".encode())
                p.stdin.flush()
                raw = p.stdout.read(int(p.stdout.readline().split()[2]) + 1)[:-1]
                if b"\0" not in raw[:8000]:
                    yield path, raw.decode("utf-8", "replace"), sha
            p.stdin.close()


class GitTree(DataSource):
    """path, text and content_id of the regular text files of a commit. Options: path, ref, partitions. Executors must see the repository."""

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "path string, text string, content_id string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _TreeReader(self.options)


class _LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.ref, self.since, self.parts = options["path"], options.get("ref", "HEAD"), options.get("since"), int(options.get("partitions", 8))

    def partitions(self) -> list[_Part]:
        since = [f"--since={self.since}"] if self.since else []
        return _cut(list(enumerate(git(self.repo, "rev-list", "--no-merges", *since, self.ref).decode().split())), self.parts)

    def read(self, partition: _Part) -> Iterator[tuple]:
        if not partition.value:
            return
        seq = {sha: k for k, sha in partition.value}
        log = subprocess.run(["git", "-C", self.repo, "log", "--no-walk=unsorted", "--stdin", "--numstat", "-M", "--format=%x01%H %ct"], check=True, capture_output=True, input="\n".join(seq).encode()).stdout
        for block in log.decode("utf-8", "replace").split("\x01")[1:]:
            head, *lines = block.split("\n")
            sha, at = head.split()
            for line in lines:
                if line:
                    yield seq[sha], sha, int(at), line


class GitLog(DataSource):
    """seq (0 is the newest), sha, at (seconds) and line (numstat) of the files of commits that are no merges. Options: path, ref, since, partitions."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "seq long, sha string, at long, line string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _LogReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitTree)
    spark.dataSource.register(GitLog)
