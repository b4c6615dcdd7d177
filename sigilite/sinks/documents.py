"""Whole reports: JSON, SARIF, baseline and console. For reports that a person or a tool takes in one piece;
large results are written as rows (``write_rows``), which never meet on the driver."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigilite import __version__
from sigilite.catalog import OWASP_EDITION, RULES, SEVERITIES, SKIP_REASONS, Config, Rule, rules_frame
from sigilite.operators import reports as R
from sigilite.operators.scan import long_lines, ordered, scan, scan_lines
from sigilite.sinks import rows

SCHEMA = "sigilite-report/1"
COMMIT_VARIABLE = "SIGILITE_COMMIT"


def canonical_sha256(document: object) -> str:
    """Over the document with sorted keys, without blanks, other scripts as they are."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def ruleset_hash(rules: tuple[Rule, ...] = RULES) -> str:
    """Over what a report tells of the rules."""
    told = sorted([r.id, r.severity, r.owasp, r.cwe, r.title, r.recommendation] for r in rules)
    return canonical_sha256({"edition": OWASP_EDITION, "rules": told})


def pattern_hash(rules: tuple[Rule, ...] = RULES) -> str:
    """Over how the rules match as well: it changes with any pattern, literal or limit."""
    how = sorted([r.id, r.pattern, list(r.literals), list(r.keywords), r.min_entropy, list(r.only_files), list(r.not_files), bool(r.validator)] for r in rules)
    return canonical_sha256({"told": ruleset_hash(rules), "how": how})


@dataclass
class Result:
    """A finished scan: findings in order, as dictionaries, with its counts."""

    findings: list[dict]
    units_scanned: int
    skipped: dict[str, int]
    placeholders: int
    duration_s: float = 0.0
    warnings: list[str] = field(default_factory=list)
    suppressed: int = 0

    def counts(self) -> dict[str, int]:
        out = dict.fromkeys(reversed(SEVERITIES), 0)
        for f in self.findings:
            out[f["severity"]] += 1
        return out

    def max_rank(self) -> int:
        return max((f["severity_rank"] for f in self.findings), default=-1)


def run(units: DataFrame, config: Config, baseline: DataFrame | None = None, history: bool = False) -> tuple[DataFrame, dict]:
    """(findings in order, counts): ``units`` as a source gives them, with skip_reason. Nothing is collected but the counts."""
    text = units.where("text IS NOT NULL")
    found = scan(text, config)
    if history:
        found = R.collapse(found.withColumn("arrival", F.struct("unit_seq", "hit_no")), "arrival")
    counts = {"units": text.count(), "placeholders": scan_lines(text, config).agg(F.coalesce(F.sum("placeholders"), F.lit(0))).first()[0]}
    skipped = dict.fromkeys(SKIP_REASONS, 0)
    skipped |= {r[0]: r[1] for r in units.where("skip_reason IS NOT NULL").groupBy("skip_reason").count().collect()}
    skipped["long_line"] = long_lines(text, config).count()
    counts["skipped"] = skipped
    counts["suppressed"] = 0
    if baseline is not None:
        counts["suppressed"] = R.suppressed_count(found, baseline).first()[0]
        found = R.new_findings(found, baseline)
    return ordered(found), counts


def write_rows(findings: DataFrame, path: str, form: str = "json") -> None:
    """One line per finding, in as many files as there are partitions: json, sarif or parquet."""
    if form == "parquet":
        findings.drop("secret").write.mode("overwrite").parquet(path)
    else:
        made = rows.json_rows(findings) if form == "json" else rows.sarif_results(findings)
        made.select("json").write.mode("overwrite").text(path)


def json_document(result: Result, commit: str | None = None, rules: tuple[Rule, ...] = RULES) -> dict:
    """The report with its own digest, taken while that field is null."""
    names = ("id", "title", "severity", "severity_rank", "path", "line", "column", "commit", "occurrences", "commit_last", "redacted", "entropy", "category", "cwe", "owasp", "recommendation", "fingerprint")
    public = [{n: f[{"id": "rule_id", "column": "column_no"}.get(n, n)] for n in names} for f in result.findings]
    out = {
        "schema": SCHEMA, "tool": "sigilite", "version": __version__, "owasp_edition": OWASP_EDITION, "commit": os.environ.get(COMMIT_VARIABLE) or commit,
        "ruleset_hash": ruleset_hash(rules), "pattern_hash": pattern_hash(rules), "artifact_sha256": None,
        "summary": {
            "total": len(public), "by_severity": result.counts(), "units_scanned": result.units_scanned, "duration_s": result.duration_s, "skipped": result.skipped,
            "placeholders_discarded": result.placeholders, "coverage_warnings": result.warnings,
        },
        "findings": public,
    }
    return {**out, "artifact_sha256": canonical_sha256(out)}


def sarif_document(result: Result, results: list[dict], commit: str | None = None, rules: tuple[Rule, ...] = RULES) -> dict:
    described = []
    for r in rules:
        cwe = (r.cwe or "").rpartition("-")[2]
        described.append({
            "id": r.id, "name": r.title, "shortDescription": {"text": r.title}, "fullDescription": {"text": r.recommendation or r.title},
            "defaultConfiguration": {"level": rows.LEVELS[r.rank]},
            "properties": {"tags": sorted({"security", "secret", r.category}), "security-severity": rows.SCORES[r.rank], "cwe": r.cwe, "owasp": r.owasp, "owasp_edition": OWASP_EDITION},
            **({"helpUri": f"https://cwe.mitre.org/data/definitions/{cwe}.html"} if cwe.isdigit() else {}),
        })
    properties = {
        "owasp_edition": OWASP_EDITION, "commit": os.environ.get(COMMIT_VARIABLE) or commit, "ruleset_hash": ruleset_hash(rules), "artifact_sha256": None,
        "skipped": result.skipped, "unitsScanned": result.units_scanned, "coverageWarnings": result.warnings,
    }
    run_ = {"tool": {"driver": {"name": "sigilite", "version": __version__, "rules": described}}, "results": results, "properties": properties}
    properties["artifact_sha256"] = canonical_sha256(run_)
    return {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run_]}


def baseline_document(entries: list[dict]) -> dict:
    """Version 1: fingerprint -> rule, path, line, redacted, severity. No secret can be had from it."""
    fields = ("rule", "path", "line", "redacted", "severity")
    return {"version": 1, "note": "accepted findings; compared by fingerprint", "findings": {e["fingerprint"]: {f: e[f] for f in fields} for e in sorted(entries, key=lambda e: e["fingerprint"])}}


def read_baseline(spark, path: str) -> DataFrame:
    """(fingerprint, rule, path, line, redacted, severity) of a baseline document; anything but an object with findings is an error."""
    text = spark.read.text(path, wholetext=True)
    entry = "struct<rule:string,path:string,line:int,redacted:string,severity:string>"
    parsed = text.select(F.from_json("value", f"struct<findings:map<string,{entry}>>").alias("d"))
    if parsed.where("d.findings IS NULL").limit(1).count():
        raise ValueError(f"{path} is no baseline")
    return parsed.select(F.explode("d.findings").alias("fingerprint", "e")).select("fingerprint", "e.*")


def console(result: Result, n_plan: int = 3) -> str:
    """Plain text; nothing in it is taken for markup, and control characters of targets are shown as such."""
    clean = lambda s: "".join(c if c.isprintable() else repr(c)[1:-1] for c in str(s))
    out = []
    for f in result.findings:
        times = f" (x{f['occurrences']})" if f["occurrences"] > 1 else ""
        at = f"@{f['commit']}" if f["commit"] else ""
        out.append(f"{f['severity'].upper():8} {f['rule_id']:26} {clean(f['path'])}:{f['line']}{at}{times}  {clean(f['line_preview'])}")
    out.append("summary: " + ", ".join(f"{k} {v}" for k, v in result.counts().items()))
    out += [f"{i}. {f['rule_id']} in {clean(f['path'])}:{f['line']}: {f['recommendation']}" for i, f in enumerate(result.findings[:n_plan], 1)]
    out.append("not scanned: " + ", ".join(f"{k} {v}" for k, v in result.skipped.items()) + f"; placeholders {result.placeholders}; accepted {result.suppressed}")
    return "\n".join(out + [f"coverage: {w}" for w in result.warnings]) + "\n"


def rules_table(spark, rules: tuple[Rule, ...] = RULES) -> str:
    shown = rules_frame(spark, rules).orderBy("rule_no").collect()
    return "\n".join(f"{r.rule_id:26} {r.severity:9} {r.category:8} {r.cwe or '-':8} {r.title}" for r in shown) + "\n"
