"""All objects of a Git repository, reachable or not, or what is staged, as a data source.

The driver lists objects with their types and sizes; what is too large is never fetched. Each partition
reads its own objects through one ``git cat-file --batch``. The repository must be visible wherever rows are made."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sigilite.catalog import Config
from sigilite.session import ship
from sigilite.sources.decode import decode_bytes
from sigilite.sources.tree import CHUNK, SCHEMA, eligible, from_options, to_options

KINDS = ("blob", "commit", "tag")
#: Seconds for a command that only lists or asks.
TIMEOUT = 120


class GitError(RuntimeError):
    """Git failed, or the repository can't show all of its history."""


def _environment() -> dict[str, str]:
    """Never a prompt, never a pager, stable output."""
    return {**os.environ, "GIT_TERMINAL_PROMPT": "0", "GIT_ASKPASS": "", "SSH_ASKPASS": "", "GIT_PAGER": "cat", "LC_ALL": "C"}


def git(repo: str, *args: str, stdin: bytes | None = None, must: bool = True) -> bytes:
    try:
        done = subprocess.run(["git", "-C", repo, *args], input=stdin or b"", capture_output=True, env=_environment(), timeout=TIMEOUT, check=False)
    except (OSError, subprocess.TimeoutExpired) as e:
        if must:
            raise GitError(f"git {args[0]} didn't finish") from e
        return b""
    if done.returncode and must:
        raise GitError(f"git {args[0]} failed: {done.stderr.decode('utf-8', 'replace').strip()[:300]}")
    return b"" if done.returncode else done.stdout


def coverage_warnings(repo: str) -> list[str]:
    """What a scan of this repository can't have seen. The remote's address is never part of it."""
    if git(repo, "config", "--get", "remote.origin.url", must=False).strip():
        return ["this repository is a clone: objects that nothing refers to stay at its origin and weren't scanned"]
    return []


def list_objects(repo: str, allow_shallow: bool = False) -> list[tuple[str, str, int, str | None]]:
    """(sha, type, size, first path) of all objects, in the order of their ids."""
    if not allow_shallow and git(repo, "rev-parse", "--is-shallow-repository").strip() == b"true":
        raise GitError("the repository is shallow: most of its history isn't here")
    paths: dict[str, str] = {}
    for line in git(repo, "rev-list", "--objects", "--all").decode("utf-8", "replace").split("\n"):
        sha, _, path = line.partition(" ")
        if path:
            paths.setdefault(sha, path)
    out = []
    for line in git(repo, "cat-file", "--batch-all-objects", "--batch-check").decode().splitlines():
        sha, kind, size = line.split(" ")
        out.append((sha, kind, int(size), paths.get(sha)))
    return sorted(out)


def message(raw: bytes) -> str | None:
    """What follows the header of a commit or tag; None if that is blank."""
    text = raw.partition(b"\n\n")[2].decode("utf-8", "replace")
    return text if text.strip() else None


class Objects(InputPartition):
    def __init__(self, rows: list[tuple[int, str, str, int, str | None, str | None]]):
        self.rows = rows


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repo = options["repo"]
        self.config = from_options(options.get("config"))
        self.allow_shallow = options.get("allowshallow", options.get("allowShallow", "false")) == "true"

    def partitions(self) -> list[Objects]:
        out, rows, size = [], [], 0
        for n, (sha, kind, bytes_, path) in enumerate(list_objects(self.repo, self.allow_shallow)):
            if kind not in KINDS:
                continue
            reason = "size" if bytes_ > self.config.max_file_size else None
            rows.append((n, sha, kind, bytes_, path, reason))
            size += 0 if reason else bytes_
            if size >= CHUNK or len(rows) >= 20_000:
                out.append(Objects(rows))
                rows, size = [], 0
        return [*out, Objects(rows)] if rows or not out else out

    def read(self, partition: Objects) -> Iterator[tuple]:
        wanted = [r for r in partition.rows if r[5] is None]
        yield from ((n, path or f"<loose object {sha[:12]}>", None, sha[:12], size, reason) for n, sha, kind, size, path, reason in partition.rows if reason)
        if not wanted:
            return
        child = subprocess.Popen(["git", "-C", self.repo, "cat-file", "--batch", "--buffer"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=_environment())
        try:
            # all names fit the pipe's reader: git reads them before it writes, since output is buffered and flushed at the end of input
            import threading

            feed = threading.Thread(target=lambda: (child.stdin.write("".join(f"{r[1]}\n" for r in wanted).encode()), child.stdin.close()), daemon=True)
            feed.start()
            for n, sha, kind, size, path, _ in wanted:
                head = child.stdout.readline().split()
                if len(head) != 3:
                    raise GitError(f"git cat-file ended before object {sha[:12]}")
                raw = child.stdout.read(int(head[2]))
                child.stdout.read(1)
                if len(raw) < int(head[2]):
                    raise GitError(f"git cat-file ended inside object {sha[:12]}")
                if kind == "blob":
                    text = decode_bytes(raw)
                    yield n, path or f"<loose object {sha[:12]}>", text, sha[:12], size, None if text is not None else "binary"
                elif (text := message(raw)) is not None:
                    yield n, f"<{kind} message {sha[:12]}>", text, sha[:12], size, None
            feed.join()
            if child.wait(TIMEOUT):
                raise GitError("git cat-file failed")
        finally:
            child.kill()
            child.stdout.close()


class HistorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(dict(self.options))


class StagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repo = options["repo"]
        self.config = from_options(options.get("config"))

    def partitions(self) -> list[Objects]:
        names = git(self.repo, "diff", "--cached", "--name-only", "-z", "--diff-filter=ACMR", must=False).split(b"\0")
        names = [n.decode("utf-8", "surrogateescape") for n in names if n]
        return [Objects([(i, "", "blob", 0, n, None) for i, n in enumerate(names[at : at + 500], at)]) for at in range(0, len(names), 500)] or [Objects([])]

    def read(self, partition: Objects) -> Iterator[tuple]:
        for n, _, _, _, path, _ in partition.rows:
            raw = git(self.repo, "show", f":{path}", must=False)
            # folders aren't excluded here: what is staged was chosen
            reason = eligible(path, len(raw), self.config)
            text = None if reason else decode_bytes(raw)
            yield n, path.encode("utf-8", "replace").decode(), text, None, len(raw), reason or (None if text is not None else "binary")


class StagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_staged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StagedReader:
        return StagedReader(dict(self.options))


def read_history(spark: SparkSession, repo: str, config: Config = Config(), allow_shallow: bool = False) -> DataFrame:
    """Blobs with their first path, and messages of commits and tags. ``commit`` is the object's own id, cut to 12 digits."""
    ship(spark)
    if not allow_shallow and git(repo, "rev-parse", "--is-shallow-repository").strip() == b"true":
        raise GitError("the repository is shallow: most of its history isn't here")
    spark.dataSource.register(HistorySource)
    return spark.read.format("git_history").option("repo", repo).option("config", to_options(config)).option("allowShallow", str(allow_shallow).lower()).load()


def read_staged(spark: SparkSession, repo: str, config: Config = Config()) -> DataFrame:
    """What the next commit would hold of added, copied, changed and renamed files."""
    ship(spark)
    spark.dataSource.register(StagedSource)
    return spark.read.format("git_staged").option("repo", repo).option("config", to_options(config)).load()


def head(repo: str) -> str | None:
    return git(repo, "rev-parse", "HEAD", must=False).decode().strip() or None


