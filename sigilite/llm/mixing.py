"""Mixing sources to target weights.

Token weights are raked (iterative proportional fitting) over cells of source, language and topic:
the source marginal comes from the targets, the language and topic marginals are those of the
eligible corpus. A cell's weight is the expected number of uses of each of its documents, at most the
source's max_uses. Documents are then drawn by calibrated probabilities: systematic sampling along the
cumulated weights of a source, its documents ordered by length, with the one of several starts of the
grid whose tokens come closest to what the source is to give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigilite.llm import tokens
from sigilite.session import materialise, spread

LANGUAGES = {"pt": ["pt", "por", "portuguese", "português", "portugues"], "en": ["en", "eng", "english", "inglês"], "es": ["es", "spa", "spanish", "español", "espanol"]}
#: Topics that are told apart, those with the most documents; the rest are one topic. With at most TARGETS
#: sources and four languages this bounds the cells that come to the driver.
TOPICS = 512
TARGETS = 500
#: Starts of the grid that are tried per source.
STARTS = 32
#: How far a share may be from its target to count as met.
TOLERANCE = 0.005


def language(col: Column) -> Column:
    """pt, en, es or other, whatever the spelling (pt-BR, EN_us, Portuguese) or case; null is other."""
    first = F.lower(F.regexp_extract(F.trim(col), r"^(\p{L}+)", 1))
    out = F.lit("other")
    for name, spellings in LANGUAGES.items():
        out = F.when(first.isin(spellings), name).otherwise(out)
    return out


def topic(repo: Column) -> Column:
    """The project a repository is about: the last part of its name in lower case. The documents name no
    topic, so this stands for it; no repository is a topic of its own."""
    return F.coalesce(F.lower(F.element_at(F.split(repo, "/"), -1)), F.lit(""))


def token_counts(df: DataFrame, folder: str) -> DataFrame:
    """Adds n_tokens; every text is tokenized whole. A null or empty text has none."""
    schema = "__id long, source string, __lang string, __topic string, n_tokens int"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokens.encoding(folder)
        for batch in batches:
            batch["n_tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.pop("__text")]
            yield batch

    return spread(df).mapInPandas(scan, schema)


def rake(cells: pd.DataFrame, wanted: dict[str, float], uses: dict[str, int], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Expected uses per document of each cell (columns source, __lang, __topic, n_tokens).

    Alternates over the topic, language and source marginals; a cell's uses stay within its source's
    limit, and what the limit keeps from one cell of a source goes to its others. The source step comes
    last, so that source shares hold to within the tolerance wherever they can be met."""
    size = cells["n_tokens"].to_numpy(float)
    source, names = pd.factorize(cells["source"])
    cap = np.array([uses[s] for s in names], float)[source]
    sums = lambda code, w, n: np.bincount(code, w * size, n)
    reach = np.minimum([wanted[s] for s in names], sums(source, cap, len(names)))
    total = reach.sum()
    others = []
    for m in ("__topic", "__lang"):
        code, labels = pd.factorize(cells[m])
        others.append((code, sums(code, np.ones(len(cells)), len(labels)) / max(size.sum(), 1)))
    weight = np.ones(len(cells))
    ratio = lambda a, b: np.divide(a, b, out=np.ones_like(b), where=b > 0)
    for _ in range(rounds):
        before = weight.copy()
        for code, share in others:
            weight *= ratio(share * total, sums(code, weight, len(share)))[code]
        weight = np.minimum(weight, cap)
        free = size > 0
        for _ in range(len(cells)):
            room = reach - sums(source, np.where(free, 0, weight), len(names))
            scale = ratio(np.maximum(room, 0), sums(source, np.where(free, weight, 0), len(names)))
            weight = np.where(free, weight * scale[source], weight)
            over = free & (weight > cap + 1e-12)
            weight = np.minimum(weight, cap)
            if not over.any():
                break
            free &= ~over
        if np.abs(weight - before).max(initial=0) < tolerance:
            break
    return weight


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, folder: str = tokens.TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(documents drawn, shares reached).

    The first: doc_id, source, n_tokens, n_uses (1 up to max_uses; documents not drawn are left out).
    The second, per target: source, target_share, n_docs, available_tokens, target_tokens,
    reached_tokens, reached_share (of all tokens drawn) and status: missing (no tokens), capped (too few even
    at max_uses), met (the share is within TOLERANCE), raised (the target's tokens were reached to within
    it, but what other sources lack makes them a larger share) or missed.

    ``total_tokens`` is the size aimed at, by default what the targets' sources hold in one pass.
    Documents of null or other sources aren't eligible; null and empty texts have no tokens and are
    never drawn; repeated rows are drawn each by itself. Without documents every source is missing. A
    source named twice among the targets counts with its last row; more than TARGETS are an error."""
    wanted = targets.select("source", "target_share", "max_uses").limit(TARGETS + 1).collect()  # a parameter table
    if len(wanted) > TARGETS:
        raise ValueError(f"more than {TARGETS} targets")
    spark = documents.sparkSession
    uses = {r["source"]: int(r["max_uses"] or 0) for r in wanted if r["source"] is not None}
    share = {r["source"]: float(r["target_share"] or 0) for r in wanted if r["source"] is not None}
    eligible = documents.where(F.col("source").isin(list(uses))).select(
        F.col("doc_id").cast("long").alias("__id"), "source", language(F.col("lang")).alias("__lang"), topic(F.col("repo")).alias("__topic"), F.col("text").alias("__text")
    )
    sized = materialise(token_counts(eligible, folder))
    known = [r[0] for r in sized.groupBy("__topic").count().orderBy(F.desc("count"), "__topic").limit(TOPICS).collect()]
    sized = sized.withColumn("__topic", F.when(F.col("__topic").isin(known), F.col("__topic")).otherwise("/"))
    # at most TARGETS x 4 languages x (TOPICS + 1) rows
    cells = sized.groupBy("source", "__lang", "__topic").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs")).toPandas()
    cells = cells.sort_values(["source", "__lang", "__topic"], ignore_index=True)
    cells["n_tokens"] = cells["n_tokens"].fillna(0).astype(float)
    total = float(total_tokens if total_tokens is not None else cells["n_tokens"].sum())
    cells["__uses"] = rake(cells, {s: p * total for s, p in share.items()}, uses) if len(cells) else []
    weights = spark.createDataFrame(
        [(s, lang, t, float(u)) for s, lang, t, u in cells[["source", "__lang", "__topic", "__uses"]].itertuples(index=False)],
        "source string, __lang string, __topic string, __uses double",
    )
    give = (cells["__uses"] * cells["n_tokens"]).groupby(cells["source"]).sum().to_dict() if len(cells) else {}
    drawn = _draw(sized.join(F.broadcast(weights), ["source", "__lang", "__topic"]), seed, give)
    reached = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("reached_tokens"))
    available = cells.groupby("source").agg(n_docs=("n_docs", "sum"), n_tokens=("n_tokens", "sum"))
    rows = []
    for s, p in share.items():
        n, size = (int(available.loc[s, "n_docs"]), int(available.loc[s, "n_tokens"])) if s in available.index else (0, 0)
        rows.append((s, p, n, size, p * total, "missing" if size == 0 else "capped" if size * uses[s] < p * total else None))
    report = spark.createDataFrame(rows, "source string, target_share double, n_docs long, available_tokens long, target_tokens double, lacks string")
    report = report.join(reached, "source", "left").fillna(0, ["reached_tokens"])
    everything = F.greatest(F.sum("reached_tokens").over(Window.partitionBy(F.lit(0))), F.lit(1))  # one row per target
    report = report.withColumn("reached_share", F.col("reached_tokens") / everything)
    close = lambda a, b: F.abs(a - b) <= TOLERANCE
    status = (
        F.when(F.col("lacks").isNotNull(), F.col("lacks"))
        .when(close(F.col("reached_share"), F.col("target_share")), "met")
        .when((F.col("reached_share") > F.col("target_share")) & close(F.col("reached_tokens") / max(total, 1), F.col("target_share")), "raised")
        .otherwise("missed")
    )
    report = report.select("source", "target_share", "n_docs", "available_tokens", "target_tokens", "reached_tokens", "reached_share", status.alias("status"))
    return drawn.select(F.col("__id").alias("doc_id"), "source", "n_tokens", "n_uses"), report


def _draw(rows: DataFrame, seed: int, give: dict[str, float]) -> DataFrame:
    """Systematic sampling: a document is used as often as its stretch of the source's cumulated
    weights holds points of a unit grid. The cumulation runs over buckets of similar length first and inside
    them second; buckets are as many as keep them to some thousands of documents, so no task sorts a
    whole source. Of STARTS starts of the grid each source takes that whose tokens come closest to ``give``."""
    noise = F.xxhash64("__id", F.lit(seed))
    rows = rows.where("n_tokens > 0").withColumn("__noise", noise)
    parts = max(256, rows.count() // 4096)
    rows = rows.withColumn("__bucket", F.floor(F.log2("n_tokens") * 8).cast("long") * parts + F.pmod(F.col("__noise"), F.lit(parts)))
    sums = rows.groupBy("source", "__bucket").agg(F.sum("__uses").alias("__sum"))
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0.0)).alias("__start"))
    inside = Window.partitionBy("source", "__bucket").orderBy("n_tokens", "__noise", "__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # kept: it is read once for the totals of all starts and once for the draw
    placed = materialise(rows.join(starts, ["source", "__bucket"]).select("__id", "source", "n_tokens", "__uses", F.round(F.col("__start") + F.sum("__uses").over(inside), 6).alias("__end")))
    low = F.round(F.col("__end") - F.col("__uses"), 6)
    uses = lambda offset: F.floor(F.col("__end") + offset) - F.floor(low + offset)
    # STARTS numbers per source
    totals = placed.groupBy("source").agg(*[F.sum(F.col("n_tokens") * uses(F.lit(i / STARTS))).alias(f"t{i}") for i in range(STARTS)]).collect()
    best = [(r["source"], min(range(STARTS), key=lambda i: (abs(r[f"t{i}"] - give.get(r["source"], 0.0)), (i * 7 + seed) % STARTS)) / STARTS) for r in totals]
    offsets = rows.sparkSession.createDataFrame(best, "source string, __offset double")
    return placed.join(F.broadcast(offsets), "source").withColumn("n_uses", uses(F.col("__offset")).cast("int")).where("n_uses > 0")
