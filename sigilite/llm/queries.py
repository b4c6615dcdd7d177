"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigilite.llm import credentials, foreign, history, leakage, mixing, mojibake, personal, pipeline, splitting
from sigilite.session import table


def p1_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Repeated rows of findings with the share of their text found in what was accepted before."""
    columns = ["fingerprint", "rule", "path", "redacted", "pos"]
    new = table(spark, d, "findings").select("*", F.col("rule_id").alias("rule"), history.position(F.col("batch_no"), F.col("finding_id")).alias("pos"))
    old = table(spark, d, "baseline").select("*", F.lit(history.BEFORE).cast("long").alias("pos"))
    found = history.repeats(new.select(columns).unionByName(old.select(columns)))
    return found.select(F.col("pos").bitwiseAND((1 << 44) - 1).alias("finding_id"), F.round("coverage", 3).alias("coverage")).distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_repeats(spark, d).select("finding_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return foreign.foreign_units(table(spark, d, "blobs")).select("unit_seq").distinct()


def p4_own(spark: SparkSession, d: str) -> DataFrame:
    """The units that remain: the project's own source, and whatever isn't code."""
    return table(spark, d, "blobs").join(p4_found(spark, d), "unit_seq", "left_anti").select("unit_seq", "path")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_repaired(spark, d).where("garbled_lines > 0").select("unit_seq").distinct()


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repair_texts(table(spark, d, "blobs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.find_personal(table(spark, d, "blobs")).distinct()


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redact_personal(table(spark, d, "blobs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.find_credentials(table(spark, d, "blobs")).select("unit_seq", "line").distinct()


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redact_credentials(table(spark, d, "blobs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """All documents with leaked spans cut out."""
    return leakage.remove_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "text", "removed_words", "dropped")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(table(spark, d, "documents"))
    return pieces.where("piece = 0").select("doc_id").distinct()


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "documents"))


def pipeline_blobs(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.prepare_blobs(table(spark, d, "blobs")).select("unit_seq", "path", "text", "garbled_lines")


def pipeline_documents(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.prepare_documents(table(spark, d, "documents"), table(spark, d, "eval_items"))


QUERIES = {
    "pipeline_blobs": pipeline_blobs, "pipeline_documents": pipeline_documents,
    "p1_found": p1_found, "p1_repeats": p1_repeats,
    "p4_found": p4_found, "p4_own": p4_own, "p5_found": p5_found, "p5_repaired": p5_repaired, "p6_found": p6_found, "p6_redacted": p6_redacted, "p7_found": p7_found, "p7_redacted": p7_redacted,
    "p8_found": p8_found, "p8_passages": p8_passages, "p8_cleaned": p8_cleaned, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_pieces": p10_pieces,
}

_MARK = r"[-_. ]+(?:c[oó]pia|copy|old|antig[oa]|nov[oa]|new|bak|backup|orig|tmp|v\d+|\(\d+\))([-_. ]|$)"

ORACLES: dict[str, str] = {
    # two values agree if one, cut to what the other shows, equals it: a view that is whole on either side
    "p1_found": rf"""
WITH r AS (
  SELECT lower(fingerprint) AS fp, rule_id AS rule, replace(path, '\', '/') AS path, redacted AS shown, batch_no * 17592186044416 + finding_id AS pos, finding_id FROM findings
  UNION ALL SELECT lower(fingerprint), rule, replace(path, '\', '/'), redacted, -1, NULL FROM baseline
), low AS (SELECT *, lower(regexp_replace(path, '^(\./)+', '')) AS p FROM r),
named AS (SELECT *, regexp_replace(regexp_replace(string_split(p, '/')[-1], '{_MARK}', '\1', 'g'), '{_MARK}', '\1', 'g') AS name, regexp_replace(p, '[^/]*$', '') AS folder FROM low),
keyed AS (SELECT *, unnest(['p' || path, 'n' || rule || '|' || name, 's' || rule || '|' || folder || '|' || regexp_replace(name, '(.)\.[^.]*$', '\1')]) AS k FROM named),
ends AS (SELECT *, CASE WHEN contains(shown, '…') THEN least(length(split_part(shown, '…', 1)), length(split_part(shown, '…', 2))) ELSE 0 END AS n FROM keyed),
views AS (SELECT *, unnest(CASE WHEN n < 2 THEN [n] ELSE range(2, n + 1) END) AS m FROM ends),
v AS (SELECT finding_id, pos, k, m = n AS whole, CASE WHEN n < 2 THEN shown ELSE concat(shown[1:m], '…', right(shown, m)) END AS v FROM views),
w AS (SELECT *, min(pos) OVER (PARTITION BY k, v) AS first, min(CASE WHEN whole THEN pos END) OVER (PARTITION BY k, v) AS first_whole FROM v),
e AS (SELECT finding_id, pos, min(pos) OVER (PARTITION BY fp) AS first FROM r)
SELECT DISTINCT finding_id FROM (
  SELECT finding_id FROM w WHERE CASE WHEN whole THEN first ELSE first_whole END < pos UNION ALL SELECT finding_id FROM e WHERE first < pos
) WHERE finding_id IS NOT NULL
""",
    # words as the operator has them: lower case, no accents, letters and digits only; 15 in a row as one string
    "p8_found": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 14], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 13)) AS k FROM w)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 14], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 13)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
""",
}
