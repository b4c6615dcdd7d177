"""What is made of findings: counts, order, collapse, comparison with a baseline and with labelled lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigilite.catalog import SEVERITIES, SKIP_REASONS, Config, rules_frame
from sigilite.functions import text as T
from sigilite.operators import lines as L
from sigilite.operators.scan import long_lines, scan_lines
from sigilite.session import materialise

#: Rank that no finding reaches: findings never make a scan fail.
NEVER = 99


def severity_name(rank: Column) -> Column:
    return F.when(rank.isNotNull(), F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1))


def severity_counts(findings: DataFrame) -> DataFrame:
    """(severity, n) of all five severities, with zeros, by the rank; findings without a rank count nowhere."""
    spark = findings.sparkSession
    every = spark.createDataFrame([(i, s) for i, s in enumerate(SEVERITIES)], "severity_rank int, severity string")
    counts = findings.groupBy("severity_rank").agg(F.count("*").alias("n"))
    # five rows on either side
    return every.join(F.broadcast(counts), "severity_rank", "left").select("severity", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def max_severity(findings: DataFrame) -> DataFrame:
    """One row: the highest severity and its rank, both null without findings."""
    return findings.agg(F.max("severity_rank").alias("severity_rank")).select(severity_name(F.col("severity_rank")).alias("severity"), "severity_rank")


def exit_code(findings: DataFrame, fail_on: str = "medium") -> DataFrame:
    """One row: 1 if a finding is at least that severe, else 0; with ``none`` always 0."""
    least = NEVER if fail_on == "none" else SEVERITIES.index(fail_on)
    return findings.agg(F.coalesce(F.max((F.col("severity_rank") >= least).cast("int")), F.lit(0)).alias("exit_code"))


def skipped(files: DataFrame, units: DataFrame, config: Config = Config()) -> DataFrame:
    """(reason, n) of all reasons, with zeros: files by path and size, and lines of units that are too long."""
    spark = files.sparkSession
    reasons = files.select(L.skip_reason(F.col("path"), F.col("size"), config).alias("reason")).where("reason IS NOT NULL")
    long = long_lines(units, config).select(F.lit("long_line").alias("reason"))
    counts = reasons.unionByName(long).groupBy("reason").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(r,) for r in SKIP_REASONS], "reason string")
    return every.join(F.broadcast(counts), "reason", "left").select("reason", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def summary(units: DataFrame, findings: DataFrame, config: Config = Config()) -> DataFrame:
    """One row: findings in all and by severity, units, long lines and placeholders."""
    by = F.map_from_entries(F.collect_list(F.struct("severity", "n")))
    counts = severity_counts(findings).agg(F.sum("n").alias("total"), by.alias("by_severity"))
    dropped = scan_lines(units, config).agg(F.coalesce(F.sum("placeholders"), F.lit(0)).alias("placeholders_discarded"))
    n = units.where("text IS NOT NULL").agg(F.count("*").alias("units_scanned"))
    long = long_lines(units, config).agg(F.count("*").alias("long_lines"))
    # one row each
    return counts.crossJoin(n).crossJoin(long).crossJoin(dropped)


def sort_key(arrival: str = "unit_seq") -> Column:
    """The order of reports as one comparable value: severity from the top, path, line, arrival."""
    return F.struct((-F.col("severity_rank")).alias("r"), F.col("path").alias("p"), F.col("line").alias("l"), F.col(arrival).alias("a"))


def numbered(findings: DataFrame, arrival: str = "unit_seq") -> DataFrame:
    """``findings`` with position, their place from 1 in the order of reports.

    Rows are range-partitioned and sorted where they are; places are offsets of partitions plus places in
    them, so that no task sees all rows. ``arrival`` must make the order total for the places to be unique to a row."""
    rows = findings.withColumn("__k", sort_key(arrival)).repartitionByRange("__k").sortWithinPartitions("__k")
    # written down, so that both uses see the same partitions
    rows = materialise(rows.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = rows.groupBy("__p").agg(F.count("*").alias("n"))
    # one row per partition
    before = counts.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    return rows.join(F.broadcast(before), "__p").withColumn("position", F.col("__o") + F.col("__i") + 1).drop("__k", "__p", "__i", "__o")


def top_plan(findings: DataFrame, n: int = 3, arrival: str = "unit_seq") -> DataFrame:
    """The n findings to deal with first."""
    return findings.orderBy(sort_key(arrival)).limit(n)


def collapse(findings: DataFrame, arrival: str = "unit_seq") -> DataFrame:
    """One row per fingerprint: its first finding in the order of reports, with the number of findings and,
    where there are several, the commit of the last one. Aggregated in part before the shuffle, whatever the copies."""
    rest = [c for c in findings.columns if c not in ("fingerprint", "occurrences", "commit_last")]
    key = sort_key(arrival)
    return (
        findings.groupBy("fingerprint")
        .agg(F.min_by(F.struct(*rest), key).alias("f"), F.count("*").cast("int").alias("occurrences"), F.max_by(F.struct("commit"), key).alias("last"))
        .select("fingerprint", *[f"f.{c}" for c in rest], "occurrences", F.when(F.col("occurrences") > 1, F.col("last.commit")).alias("commit_last"))
    )


def _prints(baseline: DataFrame) -> DataFrame:
    return baseline.select(F.lower("fingerprint").alias("__fp")).where("__fp IS NOT NULL").distinct()


def new_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint isn't accepted, letter case aside. Null fingerprints are never accepted."""
    return findings.withColumn("__fp", F.lower("fingerprint")).join(_prints(baseline), "__fp", "left_anti").drop("__fp")


def suppressed_count(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: how many findings the baseline takes away."""
    return findings.withColumn("__fp", F.lower("fingerprint")).join(_prints(baseline), "__fp", "left_semi").agg(F.count("*").alias("suppressed"))


def baseline_entries(findings: DataFrame, arrival: str = "unit_seq") -> DataFrame:
    """What a baseline keeps per fingerprint: of several findings the last in the order of reports."""
    cols = ["rule_id", "path", "line", "redacted_public", "severity"]
    last = findings.groupBy("fingerprint").agg(F.max_by(F.struct(*cols), sort_key(arrival)).alias("f"))
    return last.select("fingerprint", F.col("f.rule_id").alias("rule"), "f.path", "f.line", F.col("f.redacted_public").alias("redacted"), "f.severity")


def selected_rules(spark, config: Config) -> DataFrame:
    """The rules a configuration leaves on, as rows of the catalog."""
    on = spark.createDataFrame([(r.id,) for r in config.active()], "rule_id string")
    return rules_frame(spark, config.rules).join(F.broadcast(on), "rule_id", "left_semi")


def first_paths(objects: DataFrame, order: str) -> DataFrame:
    """(sha, path): the first path in ``order`` under which an object is listed; objects without any are left out."""
    return objects.where("sha IS NOT NULL AND path IS NOT NULL").groupBy("sha").agg(F.min_by("path", order).alias("path"))


def with_paths(blobs: DataFrame, paths: DataFrame) -> DataFrame:
    """Blobs with the path of their object; without one, a name in angle brackets that tells it is loose."""
    named = paths.select("sha", F.col("path").alias("__path"))
    return blobs.drop("path").join(named, "sha", "left").withColumn("path", F.coalesce("__path", F.concat(F.lit("<loose object "), F.coalesce("sha", F.lit("?")), F.lit(">")))).drop("__path")


def _near(rows: DataFrame, tolerance: int) -> DataFrame:
    """Every place within the tolerance of a row: an equi-join in place of a range join."""
    return rows.select(T.slashed(F.col("path")).alias("__path"), F.explode(F.sequence(F.col("line") - tolerance, F.col("line") + tolerance)).alias("__line")).distinct()


def matched(rows: DataFrame, others: DataFrame, tolerance: int = 1, how: str = "left_semi") -> DataFrame:
    """Rows with (or, by left_anti, without) one of ``others`` in the same file at most ``tolerance`` lines away. Null paths or lines match nothing."""
    keyed = rows.withColumns({"__path": T.slashed(F.col("path")), "__line": F.col("line")})
    return keyed.join(_near(others.where("path IS NOT NULL AND line IS NOT NULL"), tolerance), ["__path", "__line"], how).drop("__path", "__line")


def evaluation(labels: DataFrame, findings: DataFrame, tolerance: int = 1) -> DataFrame:
    """One row: labels, those found and missed, findings, those without a label, recall with its interval, precision.

    ``labels`` are (path, line) of real secrets."""
    n = labels.agg(F.count("*").alias("labels"))
    hit = matched(labels, findings, tolerance).agg(F.count("*").alias("found"))
    all_ = findings.agg(F.count("*").alias("findings"))
    false = matched(findings, labels, tolerance, "left_anti").agg(F.count("*").alias("unlabelled"))
    w = T.wilson(F.col("found"), F.col("labels"))
    return (
        n.crossJoin(hit).crossJoin(all_).crossJoin(false)
        .withColumns({"missed": F.col("labels") - F.col("found"), "recall": F.try_divide("found", "labels"), "__w": w})
        .withColumns({"recall_low": F.col("__w.low"), "recall_high": F.col("__w.high"), "precision": F.try_divide(F.col("findings") - F.col("unlabelled"), "findings")})
        .drop("__w")
    )


def category_rollup(findings: DataFrame) -> DataFrame:
    """Counts by category, severity and rule, with subtotals; ``level`` tells how many columns were summed up."""
    return (
        findings.withColumn("severity", severity_name(F.col("severity_rank")))
        .rollup("category", "severity", "rule_id")
        .agg(F.count("*").alias("n"), F.countDistinct("fingerprint").alias("n_fingerprints"), F.grouping_id().cast("int").alias("level"))
    )
