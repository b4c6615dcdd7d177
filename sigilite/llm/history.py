"""New batches of records against all that was accepted before.

A record becomes a few lines of text: its fingerprint, and its place (file, rule) followed by the value
it shows. Lines that can match at all share a partition. There each batch gets an immutable sparse suffix
array over its concatenated lines, with suffixes at the starts of lines and of path components; substrings
of a new batch's lines are found in it by binary search, and the longest match gives the share of a line
that is covered. Segments of equal level are merged, so that after n batches at most log2(n) are searched.

The value is written from its ends inwards ("ab…yz" as "azby"): what a view shows less of its ends is then a
prefix of what a longer one shows, and agreement as far as both show is one prefix search.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigilite.session import shared_dir, ship

#: Batch and position of what was accepted before the first batch.
BEFORE = -1

# Separators inside lines; each kind of line has its own, so that kinds never match each other.
_PLACE, _FOLDER, _RULE, _PRINT, _END = "\x1d", "\x1e", "\x1f", "\x1c", "\n"

# What a copy of a file adds to its name.
_COPY = r"[-_. ]+(?:c[oó]pia|copy|old|antig[oa]|nov[oa]|new|bak|backup|orig|tmp|v\d+|\(\d+\))(?=[-_. ]|$)"

_LINE = "h long, line string, head int, shown int, batch int, pos long"


def position(batch: Column, row: Column) -> Column:
    """Order by batch, then by row, as one number; row numbers must stay below 2^44."""
    return F.shiftleft(batch.cast("long"), 44) + row


def _short(part: Column) -> Column:
    """Long parts by digest, which keeps equality and bounds the width of a line."""
    return F.when(F.length(part) > 120, F.sha2(part, 256)).otherwise(part)


def _inwards(shown: Column) -> tuple[Column, Column]:
    """(value from its ends inwards, number of characters on either side); 0 where fewer than two show: such
    a value only agrees with the like."""
    left, right = F.substring_index(shown, "…", 1), F.substring_index(shown, "…", -1)
    n = F.least(F.length(left), F.length(right))
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(left, i, F.lit(1)), F.substring(right, F.length(right) - i + 1, F.lit(1))))
    whole = shown.contains("…") & (n >= 2)
    return F.when(whole, F.array_join(pairs, "")).otherwise(_short(shown)), F.when(whole, n).otherwise(0)


def record_lines(records: DataFrame) -> DataFrame:
    """The lines of records (fingerprint, rule, path, redacted, batch, pos): (h, line, head, shown, batch, pos).

    ``head`` is where the part begins that must match, ``shown`` the number of characters the value shows
    on either side. A record without a value has no line but its fingerprint's; without that, none."""
    path = F.regexp_replace(F.translate(F.coalesce("path", F.lit("")), "\\", "/"), r"^(?:\./)+|/(?=/)", "")
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    folder = _short(F.substring(low, F.lit(1), F.length(low) - F.length(name)))
    plain = _short(F.regexp_replace(name, _COPY, ""))
    stem = _short(F.regexp_replace(F.regexp_replace(name, _COPY, ""), r"(?<=.)\.[^.]*$", ""))
    rule = _short(F.coalesce("rule", F.lit("")))
    value, n = _inwards(F.col("redacted"))
    rows = records.select("batch", "pos", F.lower("fingerprint").alias("fp"), rule.alias("rule"), _short(F.translate(F.coalesce("path", F.lit("")), "\\", "/")).alias("path"), folder.alias("folder"), plain.alias("name"), stem.alias("stem"), value.alias("value"), n.alias("n"))
    least = F.when(F.col("n") > 0, F.substring("value", 1, 4)).otherwise(F.col("value"))

    def line(kind: str, key: list, text: list, head: Column) -> Column:
        return F.struct(F.xxhash64(F.lit(kind), *key).alias("h"), F.concat(*text).alias("line"), head.cast("int").alias("head"), F.col("n").cast("int").alias("shown"))

    valued = F.coalesce(F.col("value"), F.lit("")) != ""
    lines = F.array(
        F.when(F.col("fp").isNotNull(), F.struct(F.xxhash64(F.lit("f"), "fp").alias("h"), F.concat(F.lit(_PRINT), _short(F.col("fp"))).alias("line"), F.lit(0).alias("head"), F.lit(0).alias("shown"))),
        F.when(valued, line("p", ["path", least], ["path", F.lit(_PLACE), "value"], F.lit(0))),
        F.when(valued, line("n", ["name", "rule", least], ["folder", "name", F.lit(_RULE), "rule", F.lit(_RULE), "value"], F.length("folder"))),
        F.when(valued, line("s", ["folder", "stem", "rule", least], ["folder", "stem", F.lit(_FOLDER), "rule", F.lit(_FOLDER), "value"], F.lit(0))),
    )
    return rows.select(F.col("batch").cast("int").alias("batch"), F.col("pos").cast("long").alias("pos"), F.explode(F.array_compact(lines)).alias("l")).select("l.h", "l.line", "l.head", "l.shown", "batch", "pos")


class Segment:
    """Sparse suffix array of some lines: their suffixes in order, and the first position of each one's line."""

    def __init__(self, suffixes: np.ndarray, first: np.ndarray):
        self.suffixes, self.first = suffixes, first

    @classmethod
    def build(cls, lines: Iterable[str], heads: Iterable[int], first: np.ndarray, width: int) -> Segment:
        suffixes, owner = [], []
        for k, (line, head) in enumerate(zip(lines, heads)):
            for at in starts(line, head):
                suffixes.append((line[at:] + _END).encode())
                owner.append(k)
        array = np.array(suffixes, dtype=f"S{width}")
        order = np.argsort(array, kind="stable")
        return cls(array[order], first[np.array(owner, dtype=np.int64)][order])

    def merge(self, other: Segment) -> Segment:
        both = np.concatenate((self.suffixes, other.suffixes))
        order = np.argsort(both, kind="stable")  # two sorted runs: a merge
        return Segment(both[order], np.concatenate((self.first, other.first))[order])

    def earliest(self, patterns: np.ndarray) -> np.ndarray:
        """The first position of any line with a suffix that begins with the pattern; a huge number where there is none."""
        out = np.full(len(patterns), np.iinfo(np.int64).max)
        if len(patterns) and len(self.suffixes):
            lo = np.searchsorted(self.suffixes, patterns, "left")
            hi = np.searchsorted(self.suffixes, np.char.add(patterns, b"\xff").astype(self.suffixes.dtype), "left")
            found = np.flatnonzero(lo < hi)
            if len(found):
                # minima of the ranges; the array gets one more place so that a range may end at its end
                padded = np.append(self.first, np.iinfo(np.int64).max)
                out[found] = np.minimum.reduceat(padded, np.stack((lo[found], hi[found]), 1).ravel())[::2]
        return out


def starts(line: str, head: int) -> list[int]:
    """Where suffixes begin, the longest first: the line and its path components up to the part that must match."""
    out, at = [0], line.find("/", 0, head)
    while at >= 0:
        out.append(at + 1)
        at = line.find("/", at + 1, head)
    return out


def views(line: str, shown: int) -> list[str]:
    """What agrees with a line: whatever goes on from it, and every shorter view of its value as a whole."""
    if shown < 2:
        return [line + _END]
    base = line[: len(line) - 2 * shown]
    return [line, *(base + line[len(base) : len(base) + 2 * m] + _END for m in range(2, shown))]


def _match(segments: list[Segment], lines: list[str], shown: list[int], at: list[int], pos: np.ndarray) -> np.ndarray:
    """Whether a line from ``at`` on has a match at an earlier position in any of the segments."""
    texts, owner = [], []
    for k, (line, n, lo) in enumerate(zip(lines, shown, at)):
        for v in views(line[lo:], n):
            texts.append(v.encode())
            owner.append(k)
    found = np.zeros(len(lines), dtype=bool)
    if texts:
        owner = np.array(owner)
        patterns = np.array(texts, dtype=segments[0].suffixes.dtype if segments else None)
        for s in segments:
            found[owner[s.earliest(patterns) < pos[owner]]] = True
    return found


def search(rows: pd.DataFrame) -> pd.DataFrame:
    """(pos, coverage) of the lines of one partition that match a line at an earlier position, batch after batch."""
    if not len(rows):
        return pd.DataFrame({"pos": pd.Series(dtype="int64"), "coverage": pd.Series(dtype="float64")})
    width = int(rows["line"].str.encode("utf-8").str.len().max()) + 2
    kept: list[tuple[int, Segment]] = []
    pos_out, cover_out = [], []
    for batch, own in rows.groupby("batch", sort=True):
        pos = own["pos"].to_numpy(np.int64)
        lines, heads, shown = own["line"].tolist(), own["head"].tolist(), own["shown"].tolist()
        segment = Segment.build(lines, heads, pos, width)
        if batch != BEFORE:
            every = [s for _, s in kept] + [segment]
            hit = np.flatnonzero(_match(every, lines, shown, heads, pos))
            # the longest match of each: from the earliest start that still matches
            cover = {k: (len(lines[k]) - heads[k]) / len(lines[k]) for k in hit}
            longer = [(k, at) for k in hit for at in starts(lines[k], heads[k]) if at < heads[k]]
            if longer:
                ks = [k for k, _ in longer]
                good = _match(every, [lines[k] for k in ks], [shown[k] for k in ks], [at for _, at in longer], pos[ks])
                for (k, at), ok in zip(longer, good):
                    if ok:
                        cover[k] = max(cover[k], (len(lines[k]) - at) / len(lines[k]))
            pos_out.append(pos[hit])
            cover_out += [cover[k] for k in hit]
        kept.append((0, segment))
        while len(kept) > 1 and kept[-1][0] == kept[-2][0]:
            (level, b), (_, a) = kept.pop(), kept.pop()
            kept.append((level + 1, a.merge(b)))
    return pd.DataFrame({"pos": np.concatenate(pos_out) if pos_out else np.array([], dtype=np.int64), "coverage": np.array(cover_out, dtype=float)})


#: Lines a task holds at a time, about.
TASK_LINES = 1_000_000


def search_lines(lines: DataFrame, records: int) -> DataFrame:
    """(pos, coverage), one row per record with a match: the largest share of one of its lines found in accepted text.

    ``records`` is a bound on the records behind the lines, four lines each at most: partitions are as many as
    keep the arrays of one within a worker's memory."""
    spark = lines.sparkSession
    ship(spark)
    parts = 4 * records // TASK_LINES + 1
    few = parts <= int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a partition is what the shuffle made it: lines that may match share one, and equal lines came aggregated
        parts = list(batches)
        yield search(pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["h", "line", "head", "shown", "batch", "pos"]))

    found = (lines.repartition("h") if few else lines.repartition(parts, "h")).select("line", "head", "shown", "batch", "pos").mapInPandas(run, "pos long, coverage double")
    return found.groupBy("pos").agg(F.max("coverage").alias("coverage"))


def _first(rows: DataFrame) -> DataFrame:
    """Each distinct record once, at its first position: copies of one record never meet in a partition."""
    once = rows.groupBy("fingerprint", "rule", "path", "redacted").agg(F.min("pos").alias("pos"))
    return once.withColumn("batch", F.when(F.col("pos") < 0, BEFORE).otherwise(F.shiftright("pos", 44)).cast("int"))


def _judged(rows: DataFrame, first: DataFrame, found: DataFrame) -> DataFrame:
    """(pos, coverage) of the rows that repeat: first rows as found, copies of them whole. ``found`` is used once."""
    status = first.join(found, "pos", "left").select("pos", F.coalesce("coverage", F.lit(-1.0)).alias("coverage"))
    comparable = rows.where((F.col("pos") >= 0) & (F.col("fingerprint").isNotNull() | (F.coalesce("redacted", F.lit("")) != ""))).select("pos")
    return comparable.join(status, "pos", "left").select("pos", F.coalesce("coverage", F.lit(1.0)).alias("coverage")).where("coverage >= 0")


def repeats(rows: DataFrame) -> DataFrame:
    """(pos, coverage) of the rows that repeat something accepted before them.

    ``rows``: fingerprint, rule, path, redacted and pos, as ``position`` gives it. Positions are unique but
    for those of BEFORE, whose rows come before all others and aren't tested. A row repeats exactly if an earlier row has its
    fingerprint in any letter case, and nearly if one shows the same value in the same file: under its path
    (backslashes read as slashes); or, under the same rule, with the same name in any folder, letter case
    and with or without what copies add; or in the same folder with another extension. Null or empty
    values never repeat nearly, null fingerprints never exactly; a null path is an empty one. Copies of a
    record repeat its first row whole (coverage 1). Empty tables give no rows."""
    first = _first(rows)
    found = search_lines(record_lines(first), rows.count())
    return _judged(rows, first.where(F.col("pos") >= 0), found)


class History:
    """Accepted records in the shared folder, as immutable segments of lines with levels.

    ``check`` reads of the segments only the lines that share a hash with the new batch; ``accept`` writes
    one segment and merges those of equal level, each record being rewritten at most log2(batches) times.
    A segment is written whole before those it replaces are removed, so a lost job leaves the history as it was."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def segments(self) -> list[tuple[int, str]]:
        """(level, path) of the segments, highest level first; unfinished ones are left out."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        done = [n for n in names if n.startswith("level") and self._fs.exists(self._path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(((int(n[5:].split("-")[0]), f"{self.folder}/{n}") for n in done), reverse=True)

    def _lines(self) -> DataFrame | None:
        paths = [p for _, p in self.segments()]
        return self.spark.read.schema(_LINE).parquet(*paths) if paths else None

    def check(self, batch: DataFrame) -> DataFrame:
        """(pos, coverage) of the rows of ``batch`` that repeat an accepted record or an earlier row of the batch."""
        first = _first(batch)
        new = record_lines(first)
        old = self._lines()
        lines = new if old is None else new.unionByName(old.join(new.select("h").distinct(), "h", "left_semi").withColumns({"batch": F.lit(BEFORE), "pos": F.lit(BEFORE).cast("long")}))
        found = search_lines(lines, batch.count() + (0 if old is None else old.count()))
        return _judged(batch, first, found)

    def accept(self, batch: DataFrame) -> None:
        self._write(record_lines(_first(batch)), 0)
        while len(same := self._equal_level()) > 1:
            level, paths = same[0][0], [p for _, p in same]
            self._write(self.spark.read.schema(_LINE).parquet(*paths), level + 1)
            for p in paths:
                self._fs.delete(self._path(p), True)

    def _equal_level(self) -> list[tuple[int, str]]:
        have = self.segments()
        for a, b in zip(have, have[1:]):
            if a[0] == b[0]:
                return [a, b]
        return []

    def _write(self, lines: DataFrame, level: int) -> None:
        once = lines.groupBy("h", "line", "head", "shown").agg(F.min("batch").alias("batch"), F.min("pos").alias("pos"))
        once.sortWithinPartitions("h", "line").write.parquet(f"{self.folder}/level{level}-{uuid.uuid4().hex}")
