"""Findings as rows of the published formats. Each row is made where the finding lies; only envelopes are put together elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigilite.catalog import OWASP_EDITION, RULES, Rule, rules_frame
from sigilite.functions import text as T

# SARIF levels and scores by rank.
LEVELS = ("note", "note", "warning", "error", "error")
SCORES = ("1.0", "3.0", "5.5", "8.0", "9.5")
#: Key of our fingerprints in SARIF.
FINGERPRINT_KEY = "sigiliteSecretHash/v1"


def _by_rank(values: tuple[str, ...], rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), rank + 1)


def json_rows(findings: DataFrame) -> DataFrame:
    """(fingerprint, json): one JSON object per finding with the 17 public fields, nulls included. Never the secret."""
    fields = [
        F.col("rule_id").alias("id"), "title", "severity", "severity_rank", "path", "line", F.col("column_no").alias("column"), "commit", "occurrences", "commit_last",
        "redacted", "entropy", "category", "cwe", "owasp", "recommendation", "fingerprint",
    ]
    return findings.select("fingerprint", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(fingerprint, json): one SARIF result per finding, its value shown by two characters on either side."""
    message = F.concat("title", F.lit(": "), "redacted_public", F.lit(" — "), F.coalesce("recommendation", F.lit("")))
    region = F.struct(F.greatest("line", F.lit(1)).alias("startLine"), F.greatest("column_no", F.lit(1)).alias("startColumn"))
    place = F.struct(F.struct(T.slashed(F.col("path")).alias("uri")).alias("artifactLocation"), region.alias("region"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), _by_rank(LEVELS, F.col("severity_rank")).alias("level"), F.struct(message.alias("text")).alias("message"),
        F.array(F.struct(place.alias("physicalLocation"))).alias("locations"), F.struct(F.col("fingerprint").alias(FINGERPRINT_KEY)).alias("partialFingerprints"),
    )
    return findings.select("fingerprint", F.to_json(result, {"ignoreNullFields": "false"}).alias("json"))


def sarif_rules(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(rule_no, rule_id, level, security_severity, help_uri, tags): what SARIF tells of each rule. Tags are distinct."""
    rows = rules_frame(spark, rules)
    tags = F.array_sort(F.array_distinct(F.array(F.lit("security"), F.lit("secret"), "category")))
    return rows.select(
        "rule_no", "rule_id", _by_rank(LEVELS, F.col("severity_rank")).alias("level"), _by_rank(SCORES, F.col("severity_rank")).alias("security_severity"),
        T.cwe_link(F.col("cwe")).alias("help_uri"), F.array_join(tags, ",").alias("tags"), F.lit(OWASP_EDITION).alias("owasp_edition"),
    )
