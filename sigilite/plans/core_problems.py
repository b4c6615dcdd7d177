"""Registered queries of the general problems (2, 3) and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigilite.operators.hotkeys import heavy_keys, key_totals
from sigilite.operators.snapshots import snapshot_changes
from sigilite.session import table


def slashed(col: Column) -> Column:
    return F.translate(col, "\\", "/")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    tracked = {"path": slashed(F.col("path")), "severity": F.lower(F.trim("severity"))}
    return snapshot_changes(table(spark, d, "finding_snapshots"), "snapshot_no", "fingerprint", "loaded_at", tracked)


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    keys = {"path": slashed(F.col("path")), "rule_id": F.col("rule_id")}
    return key_totals(table(spark, d, "findings"), keys, F.col("occurrences"), F.col("batch_no"), F.col("finding_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(p3_totals(spark, d), 0.03).select("key_field", "key_value")


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_totals": p3_totals}

ORACLES = {
    "p2_found": r"""
WITH latest AS (
  SELECT snapshot_no, fingerprint, replace(path, '\', '/') AS path, lower(trim(severity)) AS severity
  FROM finding_snapshots
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, fingerprint ORDER BY loaded_at DESC, replace(path, '\', '/') DESC, lower(trim(severity)) DESC NULLS LAST) = 1
), nums AS (
  SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS prev FROM (SELECT DISTINCT snapshot_no FROM finding_snapshots)
), new AS (SELECT n.snapshot_no AS no, l.* EXCLUDE (snapshot_no) FROM latest l JOIN nums n ON l.snapshot_no = n.snapshot_no WHERE n.prev IS NOT NULL),
old AS (SELECT n.snapshot_no AS no, l.* EXCLUDE (snapshot_no) FROM latest l JOIN nums n ON l.snapshot_no = n.prev)
SELECT coalesce(n.no, o.no) AS snapshot_no, coalesce(n.fingerprint, o.fingerprint) AS fingerprint,
  CASE WHEN o.no IS NULL THEN 'added' WHEN n.no IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM new n FULL OUTER JOIN old o ON n.no = o.no AND n.fingerprint = o.fingerprint
WHERE o.no IS NULL OR n.no IS NULL OR n.path <> o.path OR n.severity IS DISTINCT FROM o.severity
""",
    "p3_totals": r"""
WITH k AS (
  SELECT 'path' AS key_field, replace(path, '\', '/') AS key_value, occurrences, batch_no, finding_id FROM findings
  UNION ALL SELECT 'rule_id', rule_id, occurrences, batch_no, finding_id FROM findings
), s AS (
  SELECT *, CASE WHEN lag(batch_no) OVER (PARTITION BY key_field, key_value ORDER BY finding_id) <> batch_no THEN 1 ELSE 0 END AS step FROM k
)
SELECT key_field, key_value, count(*) AS n_rows, CAST(sum(occurrences) AS BIGINT) AS total, CAST(sum(step) AS BIGINT) AS changes
FROM s GROUP BY key_field, key_value
""",
    "p3_found": r"""
WITH k AS (SELECT 'path' AS key_field, replace(path, '\', '/') AS key_value FROM findings UNION ALL SELECT 'rule_id', rule_id FROM findings)
SELECT key_field, key_value FROM k GROUP BY key_field, key_value
HAVING count(*) >= 0.03 * (SELECT count(*) FROM findings) AND key_value IS NOT NULL
""",
}
