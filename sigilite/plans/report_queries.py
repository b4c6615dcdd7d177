"""Registered queries of the relational operators and sinks; with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigilite.catalog import RULES, SEVERITIES, Config
from sigilite.functions import text as T
from sigilite.operators import reports as R
from sigilite.operators.scan import scan
from sigilite.plans import scan_sql as S
from sigilite.plans.units import units
from sigilite.session import table
from sigilite.sinks import rows as sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = sql


def findings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "findings")


def baseline(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "baseline")


_RANKS = ", ".join(f"({i}, '{s}')" for i, s in enumerate(SEVERITIES))
_NAME = "CASE severity_rank " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SEVERITIES)) + " END"
register(
    "severity_counts_zero_filled", lambda s, d: R.severity_counts(scan(units(s, d))),
    f"WITH {S.findings()} SELECT v.s AS severity, count(f.unit_seq) AS n FROM (VALUES {_RANKS}) v(r, s) LEFT JOIN findings_ f ON f.severity_rank = v.r GROUP BY v.s",
)
register("max_severity", lambda s, d: R.max_severity(findings(s, d)), f"SELECT {_NAME} AS severity, severity_rank FROM (SELECT max(severity_rank) AS severity_rank FROM findings)")
register("exit_code", lambda s, d: R.exit_code(findings(s, d), "critical"), "SELECT CAST(max(CASE WHEN severity_rank >= 4 THEN 1 ELSE 0 END) AS INTEGER) AS exit_code FROM findings")


def skipped_audit(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    return R.skipped(u.where("path IS NOT NULL").select("path", F.octet_length("text").alias("size")), u, Config(max_file_size=8_000))


_C = Config()
_PATH = S.base_name(r"replace(path, '\', '/')")
register(
    "skipped_audit", skipped_audit,
    rf"""WITH {S.LINES}, r AS (SELECT CASE WHEN lower(regexp_extract({_PATH}, '^.+(\.[^.]+)$', 1)) IN {S.listed(sorted(_C.binary_exts))} THEN 'binary'
      WHEN lower({_PATH}) IN {S.listed(sorted(_C.noise_files))} OR {" OR ".join(f"ends_with(lower({_PATH}), '{x}')" for x in _C.noise_suffixes)} THEN 'noise'
      WHEN strlen(text) > 8000 THEN 'size' END AS reason FROM units WHERE path IS NOT NULL UNION ALL SELECT 'long_line' FROM lines WHERE length(raw) > 4000)
    SELECT v.r AS reason, count(r.reason) AS n FROM (VALUES ('directory'), ('size'), ('noise'), ('binary'), ('long_line')) v(r) LEFT JOIN r ON r.reason = v.r GROUP BY v.r""",
)


def history_collapse(spark: SparkSession, d: str) -> DataFrame:
    return R.collapse(scan(units(spark, d)).withColumn("arrival", F.struct("unit_seq", "hit_no")), "arrival").select(
        "fingerprint", "rule_id", "path", "line", "commit", "occurrences", "commit_last"
    )


register(
    "history_collapse", history_collapse,
    f"""WITH {S.findings()}, o AS (SELECT *, row_number() OVER w AS up, row_number() OVER (PARTITION BY fingerprint ORDER BY severity_rank, path DESC NULLS FIRST, line DESC, unit_seq DESC, hit_no DESC) AS down,
      count(*) OVER (PARTITION BY fingerprint) AS n FROM findings_ WINDOW w AS (PARTITION BY fingerprint ORDER BY severity_rank DESC, path NULLS FIRST, line, unit_seq, hit_no)),
    l AS (SELECT fingerprint, commit FROM o WHERE down = 1)
    SELECT o.fingerprint, rule_id, path, line, o.commit, CAST(n AS INTEGER) AS occurrences, CASE WHEN n > 1 THEN l.commit END AS commit_last FROM o JOIN l USING (fingerprint) WHERE up = 1""",
)
register(
    "baseline_anti", lambda s, d: R.new_findings(findings(s, d), baseline(s, d)).select("finding_id", "fingerprint"),
    "SELECT finding_id, fingerprint FROM findings f WHERE NOT EXISTS (SELECT 1 FROM baseline b WHERE lower(b.fingerprint) = lower(f.fingerprint))",
)
register(
    "baseline_suppressed", lambda s, d: R.suppressed_count(findings(s, d), baseline(s, d)),
    "SELECT count(*) AS suppressed FROM findings f WHERE EXISTS (SELECT 1 FROM baseline b WHERE lower(b.fingerprint) = lower(f.fingerprint))",
)
_ONLY = Config(only=frozenset(["cpf", "jwt", "github-token"]))
_SKIP = Config(skip=frozenset(["jwt"]), skip_categories=frozenset(["pii"]), use_entropy=False)
register("rule_selection", lambda s, d: R.selected_rules(s, _ONLY).select("rule_id", "severity"), "SELECT rule_id, severity FROM rule_catalog WHERE rule_id IN ('cpf', 'jwt', 'github-token')")
register(
    "only_skip_category", lambda s, d: R.selected_rules(s, _SKIP).select("rule_id", "category", "severity_rank"),
    "SELECT rule_id, category, severity_rank FROM rule_catalog WHERE rule_id <> 'jwt' AND category NOT IN ('pii', 'entropy')",
)
register(
    "rule_metadata_join",
    lambda s, d: findings(s, d).select("finding_id", "rule_id").join(F.broadcast(R.selected_rules(s, Config()).select("rule_id", F.col("severity").alias("rule_severity"), F.col("cwe").alias("rule_cwe"))), "rule_id"),
    "SELECT f.rule_id, finding_id, r.severity AS rule_severity, r.cwe AS rule_cwe FROM findings f JOIN rule_catalog r USING (rule_id)",
)
register(
    "findings_sorted", lambda s, d: R.numbered(findings(s, d), "finding_id").select("finding_id", "position"),
    "SELECT finding_id, row_number() OVER (ORDER BY severity_rank DESC, path NULLS FIRST, line, finding_id) AS position FROM findings",
)
register(
    "top3_plan", lambda s, d: R.top_plan(findings(s, d), 3, "finding_id").select("finding_id", "rule_id", "path", "line"),
    "SELECT finding_id, rule_id, path, line FROM findings ORDER BY severity_rank DESC, path NULLS FIRST, line, finding_id LIMIT 3",
)


def path_left_join(spark: SparkSession, d: str) -> DataFrame:
    blobs = table(spark, d, "blobs")
    return R.with_paths(blobs.select("unit_seq", "sha"), R.first_paths(blobs.where("path NOT LIKE '<%'"), "unit_seq")).select("unit_seq", "sha", "path")


register(
    "path_left_join", path_left_join,
    """WITH p AS (SELECT sha, min_by(path, unit_seq) AS path FROM blobs WHERE sha IS NOT NULL AND path IS NOT NULL AND path NOT LIKE '<%' GROUP BY sha)
    SELECT unit_seq, b.sha, coalesce(p.path, concat('<loose object ', coalesce(b.sha, '?'), '>')) AS path FROM blobs b LEFT JOIN p ON b.sha = p.sha""",
)
_LABELS = r"SELECT replace(path, '\', '/') AS path, line FROM baseline WHERE line IS NOT NULL"
register(
    "corpus_recall_range_join",
    lambda s, d: R.evaluation(baseline(s, d).where("line IS NOT NULL"), findings(s, d)).select("labels", "found", "missed", "findings", "unlabelled"),
    rf"""WITH l AS ({_LABELS}), f AS (SELECT replace(path, '\', '/') AS path, line FROM findings)
    SELECT labels, found, labels - found AS missed, findings, unlabelled FROM (SELECT (SELECT count(*) FROM l) AS labels, (SELECT count(*) FROM f) AS findings,
      (SELECT count(*) FROM l WHERE EXISTS (SELECT 1 FROM f WHERE f.path = l.path AND abs(f.line - l.line) <= 1)) AS found,
      (SELECT count(*) FROM f WHERE NOT EXISTS (SELECT 1 FROM l WHERE f.path = l.path AND abs(f.line - l.line) <= 1)) AS unlabelled)""",
)


def wilson_interval(spark: SparkSession, d: str) -> DataFrame:
    rows = findings(spark, d).groupBy("rule_id").agg(F.count("*").alias("n"), F.count_if(F.col("occurrences") > 1).alias("k"))
    w = T.wilson(F.col("k"), F.col("n"))
    return rows.select("rule_id", "n", "k", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


_MID, _HALF, _SCALE = "(p + 1.96 * 1.96 / (2 * n))", "1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))", "(1 + 1.96 * 1.96 / n)"
register(
    "wilson_interval", wilson_interval,
    f"""SELECT rule_id, n, k, round(greatest(0.0, ({_MID} - {_HALF}) / {_SCALE}), 6) AS low, round(least(1.0, ({_MID} + {_HALF}) / {_SCALE}), 6) AS high FROM (
      SELECT rule_id, count(*) AS n, count(*) FILTER (occurrences > 1) AS k, CAST(count(*) FILTER (occurrences > 1) AS DOUBLE) / count(*) AS p FROM findings GROUP BY rule_id)""",
)
register(
    "category_rollup", lambda s, d: R.category_rollup(findings(s, d)),
    f"""SELECT category, severity, rule_id, count(*) AS n, count(DISTINCT fingerprint) AS n_fingerprints, CAST(grouping_id(category, severity, rule_id) AS INTEGER) AS level
    FROM (SELECT category, {_NAME} AS severity, rule_id, fingerprint FROM findings) GROUP BY ROLLUP (category, severity, rule_id)""",
)
register(
    "locations", lambda s, d: findings(s, d).select("finding_id", T.location(F.col("path"), F.col("line"), F.col("commit_sha")).alias("place"), T.cwe_link(F.col("cwe")).alias("help_uri")),
    "SELECT finding_id, concat(path, ':', line, CASE WHEN commit_sha IS NULL THEN '' ELSE '@' || commit_sha END) AS place, CASE WHEN cwe IS NOT NULL THEN concat('https://cwe.mitre.org/data/definitions/', regexp_extract(cwe, '(\\d+)', 1), '.html') END AS help_uri FROM findings".replace("\\\\", "\\"),
)

register(
    "label_paths", lambda s, d: findings(s, d).select("finding_id", T.below(F.col("path"), "config", "src", "tests").alias("inner")),
    rf"""SELECT finding_id, CASE WHEN regexp_matches(p, '(^|/)(config|src|tests)/') THEN regexp_extract(p, '(?:^|/)((?:config|src|tests)/.*)$', 1) ELSE p END AS inner
    FROM (SELECT finding_id, replace(path, '\\', '/') AS p FROM findings)""".replace("\\\\", "\\"),
)
_POOL = "translate(concat(" + ", ".join(f"base64(unhex(md5(concat('{i}:', o_orderkey))))" for i in range(6)) + "), '+/=', 'pq')"
register(
    "filled_template", lambda s, d: table(s, d, "orders").select("o_orderkey", T.filled(F.lit("id={16} key={40}"), F.col("o_orderkey")).alias("text")),
    f"SELECT o_orderkey, concat('id=', {_POOL}[1:16], ' key=', {_POOL}[1:40]) AS text FROM orders",
)
register(
    "units_scanned", lambda s, d: R.summary(units(s, d), scan(units(s, d))).select("total", "units_scanned", "long_lines", "placeholders_discarded"),
    f"""WITH {S.findings()} SELECT (SELECT count(*) FROM findings_) AS total, (SELECT count(*) FROM units WHERE text IS NOT NULL) AS units_scanned,
      (SELECT count(*) FROM lines WHERE length(raw) > 4000) AS long_lines, (SELECT count(*) FROM found WHERE fake) AS placeholders_discarded""",
)

# --- sinks -------------------------------------------------------------------------------------------

_FIELDS = ["rule_id AS id", "title", "severity", "severity_rank", "path", "line", "column_no AS \"column\"", "commit", "occurrences", "commit_last", "redacted", "entropy", "category", "cwe", "owasp", "recommendation", "fingerprint"]
_STRUCT = ", ".join(f"'{f.split(' AS ')[-1].strip(chr(34))}': {f.split(' AS ')[0]}" for f in _FIELDS)
_LEVEL = "CASE severity_rank " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(sinks.LEVELS)) + " END"
_SCORE = "CASE severity_rank " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(sinks.SCORES)) + " END"
register("json_rows", lambda s, d: sinks.json_rows(scan(units(s, d))), f"WITH {S.findings()} SELECT fingerprint, CAST(to_json({{{_STRUCT}}}) AS VARCHAR) AS json FROM findings_")
register(
    "sarif_results", lambda s, d: sinks.sarif_results(scan(units(s, d))),
    rf"""WITH {S.findings()} SELECT fingerprint, CAST(to_json({{'ruleId': rule_id, 'level': {_LEVEL}, 'message': {{'text': concat(title, ': ', redacted_public, ' — ', coalesce(recommendation, ''))}},
      'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': replace(path, '\', '/')}}, 'region': {{'startLine': line, 'startColumn': column_no}}}}}}],
      'partialFingerprints': {{'{sinks.FINGERPRINT_KEY}': fingerprint}}}}) AS VARCHAR) AS json FROM findings_""",
)
_ORDER = "CASE rule_id " + " ".join(f"WHEN '{r.id}' THEN {i}" for i, r in enumerate(RULES)) + " END"
register(
    "sarif_rules", lambda s, d: sinks.sarif_rules(s),
    f"""SELECT CAST({_ORDER} AS INTEGER) AS rule_no, rule_id, {_LEVEL} AS level, {_SCORE} AS security_severity, concat('https://cwe.mitre.org/data/definitions/', cwe[5:], '.html') AS help_uri,
      array_to_string(list_sort(list_distinct(['security', 'secret', category])), ',') AS tags, '2025' AS owasp_edition FROM rule_catalog""",
)
register(
    "baseline_entries", lambda s, d: R.baseline_entries(scan(units(s, d)).withColumn("arrival", F.struct("unit_seq", "hit_no")), "arrival"),
    f"""WITH {S.findings()} SELECT fingerprint, rule_id AS rule, path, line, redacted_public AS redacted, severity FROM findings_
    QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY severity_rank, path DESC NULLS FIRST, line DESC, unit_seq DESC, hit_no DESC) = 1""",
)


# --- all stages --------------------------------------------------------------------------------------


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Units to a numbered report of what is new: scan, collapse of equal findings, baseline, order."""
    found = R.collapse(scan(units(spark, d)).withColumn("arrival", F.struct("unit_seq", "hit_no")), "arrival")
    accepted = findings(spark, d).where("batch_no = 1").select("fingerprint").unionByName(baseline(spark, d).select("fingerprint"))
    return R.numbered(R.new_findings(found, accepted), "arrival").select("position", "fingerprint", "rule_id", "severity", "path", "line", "occurrences")


register(
    "pipeline", pipeline,
    f"""WITH {S.findings()}, o AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY severity_rank DESC, path NULLS FIRST, line, unit_seq, hit_no) AS up, count(*) OVER (PARTITION BY fingerprint) AS n FROM findings_),
    f AS (SELECT * FROM o WHERE up = 1 AND fingerprint NOT IN (SELECT lower(fingerprint) FROM findings WHERE batch_no = 1 AND fingerprint IS NOT NULL UNION ALL SELECT lower(fingerprint) FROM baseline WHERE fingerprint IS NOT NULL))
    SELECT row_number() OVER (ORDER BY severity_rank DESC, path NULLS FIRST, line, unit_seq, hit_no) AS position, fingerprint, rule_id, severity, path, line, CAST(n AS INTEGER) AS occurrences FROM f""",
)
