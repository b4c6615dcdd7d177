"""What changed between consecutive full snapshots of a table.

Each snapshot is ordered by (segment of the key's hash, key) and cut into content-defined chunks: a row
ends a chunk when the hash of its key says so, hence an insertion or removal only moves the cuts next to
it. A chunk has a 128-bit digest over its rows. Chunks with an equal digest in both snapshots are
discarded, and only rows of the remaining chunks are compared by key.

Rows travel twice: once to find each key's latest version, folded before the shuffle, and once, by then
reduced to key and content hash, to their segment. All later steps work within the segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, TimestampNTZType, TimestampType

from sigilite.functions.keys import decode_key, encode_key

#: Rows of a segment and snapshot, about: what one sort of keys sees.
SEGMENT_ROWS = 50_000

_WORD = "18446744073709551616"  # 2^64
_HALF = "9223372036854775808"  # 2^63


def _ticks(df: DataFrame, version: str) -> Column:
    """The version as a number; null comes before all others."""
    kind = df.schema[version].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        number = F.unix_micros(F.col(version).cast("timestamp"))
    elif isinstance(kind, NumericType):
        number = F.col(version).cast("long")
    else:
        raise TypeError(f"{version} must be a number or a timestamp")
    return F.coalesce(number, F.lit(-(1 << 60)))


def _latest(df: DataFrame, snapshot: str, key: str, version: str, tracked: dict[str, Column]) -> DataFrame:
    """(__no, __key, __h): the content hash of each key's row with the greatest version; of ties the greatest hash.

    Version and hash are packed into one decimal, which a hash aggregation can hold: rows are folded on the
    map side, so that a key repeated in a third of the rows doesn't travel."""
    content = F.xxhash64(*[encode_key(c) for c in tracked.values()])
    rows = df.where(F.col(snapshot).isNotNull()).select(F.col(snapshot).alias("__no"), encode_key(F.col(key)).alias("__key"), _ticks(df, version).alias("__v"), content.alias("__h"))
    whole = lambda c: f"cast({c} as decimal(20,0))"
    pack = F.expr(f"cast(({whole('__v')} + {1 << 61}BD) * {_WORD}BD + ({whole('__h')} + {_HALF}BD) as decimal(38,0))")
    best = rows.groupBy("__no", "__key").agg(F.max(pack).alias("__p"))
    return best.select("__no", "__key", F.expr(f"cast(__p % {_WORD}BD - {_HALF}BD as bigint)").alias("__h"))


def chunked(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Adds the chunk each row belongs to, named by the cut key that precedes it. Rows lie in their segments."""
    order = Window.partitionBy("__seg", "__i").orderBy("__key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.when(F.pmod(F.xxhash64(F.lit("cut"), "__key"), F.lit(chunk_rows)) == 0, F.xxhash64("__key"))
    return rows.withColumn("__chunk", F.coalesce(F.last(cut, ignorenulls=True).over(order), F.lit(0)))


def snapshot_changes(df: DataFrame, snapshot: str, key: str, version: str, tracked: dict[str, Column], chunk_rows: int = 64) -> DataFrame:
    """Keys that were added, removed or changed from each snapshot to the next.

    Returns (``snapshot``, ``key``, change); ``tracked`` maps a name to the normalised value that
    counts as content. Rows belong to their snapshot however late they were loaded. A null tracked
    value is a value of its own, a null key is one key, rows without a snapshot number belong to no
    snapshot and have no result; a null version counts as the oldest. The first snapshot has no changes.
    An empty table gives no rows. ``version`` is a number or a timestamp.

    Contents are told apart by 64 bits, which are compared only between two rows of one key; chunks by two
    more such hashes and the number of rows. Rows of a chunk have distinct keys, so equal rows can't cancel out."""
    # one row per delivery
    numbers = df.where(F.col(snapshot).isNotNull()).select(F.col(snapshot).alias("__no")).distinct()
    numbers = numbers.withColumn("__i", F.row_number().over(Window.orderBy("__no"))).withColumn("__next", F.lead("__no").over(Window.orderBy("__no")))
    segments = max(16, df.count() // SEGMENT_ROWS)
    rows = (
        _latest(df, snapshot, key, version, tracked)
        .join(F.broadcast(numbers), "__no")
        .withColumn("__seg", F.pmod(F.xxhash64("__key"), F.lit(segments)))
        .repartition("__seg")
    )
    rows = chunked(rows, chunk_rows)
    one = Window.partitionBy("__seg", "__chunk", "__i")
    mixed = lambda tag: F.bit_xor(F.xxhash64(F.lit(tag), "__key", "__h")).over(one)
    rows = rows.withColumns({"__d1": mixed("a"), "__d2": mixed("b"), "__n": F.count("*").over(one)})
    beside = Window.partitionBy("__seg", "__chunk").orderBy("__i")
    same = lambda step: F.coalesce(
        (F.first("__d1").over(beside.rangeBetween(step, step)) == F.col("__d1")) & (F.first("__d2").over(beside.rangeBetween(step, step)) == F.col("__d2"))
        & (F.first("__n").over(beside.rangeBetween(step, step)) == F.col("__n")), F.lit(False),
    )
    rows = rows.withColumns({"__as_new": ~same(-1) & (F.col("__i") > 1), "__as_old": ~same(1) & F.col("__next").isNotNull()})
    # a row may be the new side of its own snapshot and the old side of the next
    sides = F.array_compact(
        F.array(
            F.when(F.col("__as_new"), F.struct(F.col("__no").alias("to"), F.col("__h").alias("new"), F.lit(None).cast("long").alias("old"))),
            F.when(F.col("__as_old"), F.struct(F.col("__next").alias("to"), F.lit(None).cast("long").alias("new"), F.col("__h").alias("old"))),
        )
    )
    pairs = rows.where("__as_new OR __as_old").select("__seg", "__key", F.inline(sides)).groupBy("__seg", "__key", "to").agg(F.max("new").alias("new"), F.max("old").alias("old"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return pairs.select(F.col("to").alias(snapshot), decode_key(F.col("__key")).alias(key), change.alias("change")).where("change IS NOT NULL")
