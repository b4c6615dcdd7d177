"""Per-key results without imbalance, by exact offset chunking.

1. The input is cut into splits: ranges of its order that hold about as many rows each.
2. Rows are counted per (split, key); a prefix sum over the splits of a key gives each its offset.
3. Rows travel once, to their (key, split), and are numbered there: offset + place inside the split.
4. ``row number div chunk_rows`` cuts every key into chunks of equal size; a key with a third of all rows
   lies in as many splits as any other third, and becomes many chunks.
5. Per key, the states of chunks are folded in order; measures that depend on the order use the values at
   the boundaries.

No step gathers more of a key than one split's rows, or one state per chunk and split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigilite.functions.keys import decode_key, encode_key
from sigilite.session import materialise

#: Ranges between quantiles of the order, each cut evenly into further splits where the table is large.
QUANTILES = 64


def split_of(df: DataFrame, order: Column, chunk_rows: int) -> Column:
    """The split of a row by its order, a number or a timestamp; null comes first, as split 0.

    Quantiles are found in one pass over the order alone; they only balance the work. With few rows there
    is one split."""
    number = order.cast("double")
    rows = df.count()
    wanted = -(-rows // max(1, chunk_rows))
    if wanted <= 1:
        return F.lit(0)
    n = min(QUANTILES, wanted)
    bounds = sorted(set(df.select(number.alias("o")).approxQuantile("o", [i / n for i in range(n + 1)], 0.002)))
    if len(bounds) < 2:
        return F.lit(0)
    inner = max(1, -(-wanted // n))

    def tree(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            if inner == 1:
                return F.lit(lo * inner)
            part = F.floor((number - bounds[lo]) / (bounds[hi] - bounds[lo]) * inner).cast("int")
            return lo * inner + F.least(F.greatest(part, F.lit(0)), F.lit(inner - 1))
        mid = (lo + hi) // 2
        return F.when(number < bounds[mid], tree(lo, mid)).otherwise(tree(mid, hi))

    return F.when(number.isNull(), 0).otherwise(tree(0, len(bounds) - 1))


def numbered_by_key(df: DataFrame, keys: dict[str, Column], carry: dict[str, Column], order: Column, chunk_rows: int) -> DataFrame:
    """One row per input row and key field: key_field, __key, __split, row_no from 0, chunk and the carried columns.

    Rows are numbered by ``order``; ties by the carried columns, so that the numbering doesn't depend on how
    the table is stored."""
    fields = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), encode_key(c).alias("k")) for i, c in enumerate(keys.values())]))
    rows = df.select(split_of(df, order, chunk_rows).alias("__split"), order.alias("__o"), *[c.alias(f"__c_{n}") for n, c in carry.items()], fields.alias("__f")).select(
        "__split", "__o", F.col("__f.f").alias("__field"), F.col("__f.k").alias("__key"), *[F.col(f"__c_{n}").alias(n) for n in carry]
    )
    group = ["__field", "__key", "__split"]
    counts = rows.groupBy(*group).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__field", "__key").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = rows.withColumn("__at", F.row_number().over(Window.partitionBy(*group).orderBy("__o", *carry)) - 1)
    out = inside.join(offsets, group).withColumn("row_no", F.col("__offset") + F.col("__at")).drop("__offset", "__at")
    name = F.element_at(F.array(*map(F.lit, keys)), F.col("__field") + 1)
    return out.withColumn("chunk", F.expr(f"row_no div {int(chunk_rows)}")).withColumn("key_field", name)


def key_totals(df: DataFrame, keys: dict[str, Column], value: Column, marker: Column, order: Column, chunk_rows: int = 100_000) -> DataFrame:
    """Per key: rows, sum of ``value``, and ``changes``, how often ``marker`` differs between rows that follow
    each other in ``order`` (a measure that depends on the order and needs the states at boundaries).

    Returns (key_field, key_value, n_rows, total, changes). Null values are left out of the sum, a sum of
    nulls only is null; a null key is a key of its own; null markers equal each other; null orders come first;
    rows equal in order are taken by value and marker. Repeated rows count as often as they occur. An
    empty table gives no rows. ``marker`` is a whole number or null."""
    # one number per marker, null included, which fits a hash aggregation
    mark = F.coalesce(marker.cast("long"), F.lit(-(1 << 63)))
    rows = numbered_by_key(df, keys, {"__v": value.cast("long"), "__m": mark}, order, chunk_rows)
    group = ["__field", "__key", "__split"]
    line = Window.partitionBy(*group).orderBy("row_no")
    rows = rows.withColumns({"__m0": F.lag("__m").over(line), "__c0": F.lag("chunk").over(line), "__c1": F.lead("chunk").over(line)})
    opens, closes = F.col("__c0").isNull() | (F.col("__c0") != F.col("chunk")), F.col("__c1").isNull() | (F.col("__c1") != F.col("chunk"))
    states = rows.groupBy(*group, "chunk", "key_field").agg(
        F.count("*").alias("n"),
        F.sum("__v").alias("s"),
        F.sum(F.when(~opens & (F.col("__m0") != F.col("__m")), 1).otherwise(0)).alias("c"),
        F.max(F.when(opens, F.col("__m"))).alias("first"),
        F.max(F.when(closes, F.col("__m"))).alias("last"),
    )
    edge = F.lag("last").over(Window.partitionBy("__field", "__key").orderBy("__split", "chunk"))
    return (
        states.withColumn("__edge", F.when(edge != F.col("first"), 1).otherwise(0))
        .groupBy("key_field", "__key")
        .agg(F.sum("n").alias("n_rows"), F.sum("s").alias("total"), F.sum(F.col("c") + F.col("__edge")).alias("changes"))
        .select("key_field", decode_key(F.col("__key")).alias("key_value"), "n_rows", "total", "changes")
    )


def heavy_keys(totals: DataFrame, share: float) -> DataFrame:
    """Keys that hold at least ``share`` of all rows of their field; the null key is no value."""
    totals = materialise(totals)  # one row per key, read for the fields' sizes and for the keys
    # one row per key field: the number of fields bounds the broadcast
    sizes = totals.groupBy("key_field").agg(F.sum("n_rows").alias("__all"))
    return totals.join(F.broadcast(sizes), "key_field").where((F.col("n_rows") >= F.lit(share) * F.col("__all")) & F.col("key_value").isNotNull()).drop("__all")
