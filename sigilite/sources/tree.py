"""A tree of files as a data source: ``spark.read.format("code_tree").option("root", path)``.

Spark's own file source leaves out names that begin with a dot, environment files among them. Folders are
listed on the driver, whole trees pruned there; contents are read where the rows are made."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sigilite.catalog import Config
from sigilite.session import ship
from sigilite.sources.decode import decode_bytes

SCHEMA = "unit_seq long, path string, text string, commit string, size long, skip_reason string"
#: Bytes of files per partition, about.
CHUNK = 32 << 20


def eligible(path: str, size: int, config: Config) -> str | None:
    """Why a file isn't read, None where it is: binary ending, noise, size, in this order."""
    name = os.path.basename(path).lower()
    stem, ext = os.path.splitext(name)
    if stem and ext in config.binary_exts:
        return "binary"
    if not config.scan_noise_files and (name in config.noise_files or name.endswith(tuple(config.noise_suffixes))):
        return "noise"
    return "size" if size > config.max_file_size else None


def walk(root: str, config: Config) -> Iterator[tuple[str, int, str | None]]:
    """(path, size, skip reason) of every file below a root, and one row per pruned folder.

    Nothing outside the root's real folder is visited, whatever links lead there, and no folder twice."""
    if os.path.isfile(root):
        size = os.path.getsize(root)
        yield root, size, eligible(root, size, config)
        return
    home = os.path.realpath(root)
    seen, stack = {home}, [root]
    while stack:
        folder = stack.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            real = os.path.realpath(e.path)
            if os.path.commonpath((home, real)) != home:
                continue
            if os.path.isdir(e.path):
                if e.name in config.exclude_dirs or os.path.exists(os.path.join(e.path, "pyvenv.cfg")):
                    yield e.path, 0, "directory"
                elif real not in seen:
                    seen.add(real)
                    stack.append(e.path)
            elif os.path.isfile(e.path):
                size = os.path.getsize(e.path)
                yield e.path, size, eligible(e.path, size, config)


def to_options(config: Config) -> str:
    names = ("max_file_size", "scan_noise_files", "exclude_dirs", "noise_files", "noise_suffixes", "binary_exts")
    return json.dumps({n: sorted(v) if isinstance(v := getattr(config, n), (frozenset, tuple)) else v for n in names})


def from_options(text: str | None) -> Config:
    given = json.loads(text or "{}")
    return replace(Config(), **{n: tuple(v) if n == "noise_suffixes" else frozenset(v) if isinstance(v, list) else v for n, v in given.items()})


class Files(InputPartition):
    def __init__(self, rows: list[tuple[int, str, int, str | None]]):
        self.rows = rows


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = json.loads(options["roots"]) if "roots" in options else [options["root"]]
        self.config = from_options(options.get("config"))

    def partitions(self) -> list[Files]:
        out, rows, size, n = [], [], 0, 0
        # several roots follow each other; a file below two of them is listed twice
        for root in self.roots:
            for path, bytes_, reason in walk(root, self.config):
                rows.append((n, path, bytes_, reason))
                n, size = n + 1, size + (bytes_ if reason is None else 0)
                if size >= CHUNK or len(rows) >= 10_000:
                    out.append(Files(rows))
                    rows, size = [], 0
        return [*out, Files(rows)] if rows or not out else out

    def read(self, partition: Files) -> Iterator[tuple]:
        for n, path, size, reason in partition.rows:
            text = None
            if reason is None:
                try:
                    with open(path, "rb") as f:
                        text = decode_bytes(f.read())
                except OSError:
                    text = None
                reason = "binary" if text is None else None
            yield n, path, text, None, size, reason


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "code_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def read_tree(spark: SparkSession, roots: list[str], config: Config = Config()) -> DataFrame:
    """One row per file, text null and skip_reason set for what isn't scanned, and one row per pruned folder."""
    ship(spark)
    spark.dataSource.register(TreeSource)
    return spark.read.format("code_tree").option("roots", json.dumps(roots)).option("config", to_options(config)).load()
