"""Registered queries of the scan: one per rule, function, line operator, hit operator, and the whole scan; with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigilite.catalog import RULES, SECRET_CONTEXT, Config
from sigilite.functions import taxid, verdicts
from sigilite.functions import text as T
from sigilite.operators import lines as L
from sigilite.operators.scan import drop_overlaps, is_pinned, is_slash_in_quoted, long_lines, scan, scan_lines
from sigilite.plans import scan_sql as S
from sigilite.plans.units import units
from sigilite.sources.decode import SIGNATURES, decode_text, text_encoding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# --- the scan, and each rule by itself --------------------------------------------------------------


def scan_findings(spark: SparkSession, d: str) -> DataFrame:
    return scan(units(spark, d))


register("scan_findings", scan_findings, f"WITH {S.findings()} SELECT * FROM findings_")

_RULE_COLUMNS = ["unit_seq", "line", "column_no", "rule_id", "severity", "redacted", "entropy", "fingerprint"]


def _rule_query(rule_id: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: scan(units(spark, d), Config(only=frozenset([rule_id]))).select(*_RULE_COLUMNS)


for _r in RULES:
    register("rule_" + _r.id.replace("-", "_"), _rule_query(_r.id), f"WITH {S.findings((_r,))} SELECT {', '.join(_RULE_COLUMNS)} FROM findings_")


# --- functions over all strings of the units ---------------------------------------------------------

_TOKEN = r"[^\s\x22'`,;()<>\[\]]+"


def _strings(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct string between blanks, quotes and brackets."""
    return units(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0))).alias("s")).distinct()


_STRINGS = f"{S.UNITS}, strings AS (SELECT DISTINCT unnest(regexp_extract_all(text, {S.q(_TOKEN)})) AS s FROM units WHERE text IS NOT NULL)"


def _function(name: str, column: Callable[[Column], Column], sql: Callable[[str], str], of: str | None = None) -> None:
    """A query of (s, result); ``of`` is a pattern the strings must match."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = _strings(spark, d)
        return (rows.where(F.col("s").rlike(of)) if of else rows).select("s", column(F.col("s")).alias("result"))

    register(name, query, f"WITH {_STRINGS} SELECT s, {sql('s')} AS result FROM strings" + (f" WHERE regexp_matches(s, {S.q(of)})" if of else ""))


_function("shannon_entropy", lambda s: F.round(T.shannon_entropy(s), 6), lambda s: f"round({S.entropy(s)}, 6)")
_function("miller_madow", lambda s: F.round(T.corrected_entropy(s), 6), lambda s: f"round({S.corrected(s)}, 6)")
_function("alphabet_size", T.alphabet_size, lambda s: f"CAST({S.alphabet(s)} AS INTEGER)")
_function("high_entropy", T.is_high_entropy, S.high)
_function("consonant_run", T.consonant_run, lambda s: f"CAST({S.consonants(s)} AS INTEGER)")
_function("char_classes", T.char_classes, S.classes)
_function("code_identifier", T.is_code_identifier, S.identifier)
_function("url_encoded", T.is_url_encoded, S.url_encoded)
_function("hash_or_id", T.is_hash_or_id, S.hash_or_id)
_function("cpf_check", taxid.cpf_valid, lambda s: S.tax_number(s, taxid.CPF_WEIGHTS), "[0-9].*[0-9]")
_function("cnpj_check", taxid.cnpj_valid, lambda s: S.tax_number(s, taxid.CNPJ_WEIGHTS), "[0-9].*[0-9]")
_function("redact_keep4", T.redact, S.redacted)
_function("redact_keep2", lambda s: T.redact(s, 2), lambda s: S.redacted(s, 2))
_function("obvious_fake", verdicts.is_obvious_fake, S.obvious_fake)
_function("placeholder", verdicts.looks_like_placeholder, S.placeholder)
_function("example_url", verdicts.is_example_url, S.example_url, "://")
_function("password_looks_real", verdicts.password_looks_real, S.real_password)
_function("basic_auth_verdict", verdicts.login_url_leaks, S.login_leaks, "://")
_function("secret_value", verdicts.looks_like_secret_value, S.secret_value)
_function("secret_token", verdicts.looks_like_secret_token, S.secret_token)
_function("tax_digits", lambda s: taxid.digits(s), lambda s: f"regexp_replace({s}, '[^0-9]', '', 'g')", "[0-9]")


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    from sigilite.session import table

    return table(spark, d, "findings").select("finding_id", T.fingerprint(F.col("rule_id"), F.col("path"), F.col("redacted")).alias("computed"))


register("fingerprint", fingerprints, f"SELECT finding_id, {S.fingerprint('rule_id', 'path', 'redacted')} AS computed FROM findings")


# --- lines -------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return L.explode_lines(units(spark, d).where("text IS NOT NULL"))


def _line(name: str, flag: Callable[[Column], Column], sql: Callable[[str], str], columns: str = "unit_seq, line") -> None:
    """A query of the lines for which something holds."""
    cols = columns.split(", ")
    register(name, lambda spark, d: _lines(spark, d).where(flag(F.col("raw"))).select(*cols), f"WITH {S.LINES} SELECT {columns} FROM lines WHERE {sql('raw')}")


register(
    "line_explode",
    lambda spark, d: _lines(spark, d).select("unit_seq", "line", F.length("raw").alias("n"), F.md5("raw").alias("digest")),
    f"WITH {S.LINES} SELECT unit_seq, line, CAST(length(raw) AS INTEGER) AS n, md5(raw) AS digest FROM lines",
)
register("long_line_audit", lambda spark, d: long_lines(units(spark, d)), f"WITH {S.LINES} SELECT unit_seq, line, CAST(length(raw) AS INTEGER) AS n_chars FROM lines WHERE length(raw) > 4000")
register("pem_state", lambda spark, d: _lines(spark, d).where("in_pem").select("unit_seq", "line"), f"WITH {S.LINES} SELECT unit_seq, line FROM lines WHERE in_pem")
_line("allowlist_filter", lambda raw: L.is_allowed(raw, Config()), S.allowed)
_line("payload_gate", L.is_payload, S.payload)
_line("keyword_gate", lambda raw: L.has_word(raw, SECRET_CONTEXT), lambda raw: S.words(raw, SECRET_CONTEXT))
_line("hash_context_gate", L.has_hash_context, lambda raw: S.words(raw, S.HASH_CONTEXT))


def _unit(name: str, flag: Callable[[], Column], sql: str) -> None:
    register(name, lambda spark, d: units(spark, d).where(flag()).select("unit_seq", "path"), f"WITH {S.UNITS} SELECT unit_seq, path FROM units WHERE {sql}")


_C = Config()
_unit("dotenv_sniff", lambda: L.looks_like_dotenv(F.col("text")), S.dotenv_text("text"))
_unit("dotenv_filename", lambda: L.name_matches(F.col("path"), L.DOTENV_NAMES, L.DOTENV_TEMPLATES), S.dotenv_name("path"))
_unit("dotenv_routing", lambda: L.is_dotenv(F.col("path"), F.col("text")), S.dotenv())
_unit("test_path", lambda: L.is_test_path(F.col("path")), S.test_path())
_unit("synthetic_path", lambda: L.is_synthetic(F.col("path")), "regexp_matches(path, '^<[^>]*>$')")
_NAME = S.base_name(r"replace(path, '\', '/')")
_NOISE = f"(lower({_NAME}) IN {S.listed(sorted(_C.noise_files))} OR " + " OR ".join(f"ends_with(lower({_NAME}), {S.q(x)})" for x in _C.noise_suffixes) + ")"
_BINARY = rf"lower(regexp_extract({_NAME}, '^.+(\.[^.]+)$', 1)) IN {S.listed(sorted(_C.binary_exts))}"
_unit("noise_files", lambda: L.is_noise_file(F.col("path"), _C), _NOISE)
_unit("binary_ext", lambda: L.has_binary_ext(F.col("path"), _C), _BINARY)


# --- hits --------------------------------------------------------------------------------------------


def overlap_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Lines with overlapping matches: how many there were and how many are left."""
    rows = scan_lines(units(spark, d)).select("unit_seq", "line", F.size("hits").alias("n"), F.size(drop_overlaps(F.col("hits"))).alias("n_kept"))
    return rows.where("n > n_kept")


register(
    "overlap_dedupe", overlap_dedupe,
    f"WITH {S.findings()} SELECT unit_seq, line, CAST(len(hs) AS INTEGER) AS n, CAST(len(fs) AS INTEGER) AS n_kept FROM free WHERE len(hs) > len(fs)",
)
register(
    "multi_secret_preview",
    lambda spark, d: scan(units(spark, d)).where("hit_no = 1").select("unit_seq", "line", "line_preview"),
    f"WITH {S.findings()} SELECT unit_seq, line, line_preview FROM findings_ WHERE hit_no = 1",
)
register(
    "test_path_demotion",
    lambda spark, d: scan(units(spark, d)).where((F.col("rule_id").isin("generic-assignment", "high-entropy-string"))).select("unit_seq", "line", "hit_no", "severity", "severity_rank"),
    f"WITH {S.findings()} SELECT unit_seq, line, hit_no, severity, severity_rank FROM findings_ WHERE rule_id IN ('generic-assignment', 'high-entropy-string')",
)
register(
    "placeholder_count",
    lambda spark, d: scan_lines(units(spark, d)).agg(F.coalesce(F.sum("placeholders"), F.lit(0)).alias("placeholders_discarded")),
    f"WITH {S.hits()} SELECT count(*) AS placeholders_discarded FROM found WHERE fake",
)


def _slots(spark: SparkSession, d: str) -> DataFrame:
    """Places of all runs of 24 or more characters of base64 without slashes."""
    rows = _lines(spark, d).where(F.col("raw").rlike("[A-Za-z0-9+=_-]{24}"))
    return rows.select("unit_seq", "line", "raw", F.length(F.regexp_extract("raw", r"\A(.*?)[A-Za-z0-9+=_-]{24}", 1)).alias("start"))


_SLOTS = f"{S.LINES}, slots AS (SELECT unit_seq, line, raw, length(regexp_extract(raw, '^(.*?)[A-Za-z0-9+=_-]{{24}}', 1)) AS start FROM lines WHERE regexp_matches(raw, '[A-Za-z0-9+=_-]{{24}}'))"
register("pin_drop", lambda spark, d: _slots(spark, d).where(is_pinned(F.col("raw"), F.col("start"))).select("unit_seq", "line"), f"WITH {_SLOTS} SELECT unit_seq, line FROM slots WHERE start > 0 AND raw[start] = '@'")
register(
    "quoted_slash_drop",
    lambda spark, d: _slots(spark, d).where(is_slash_in_quoted(F.col("raw"), F.col("start"))).select("unit_seq", "line"),
    rf"WITH {_SLOTS} SELECT unit_seq, line FROM slots WHERE start >= 2 AND raw[start] = '/' AND regexp_matches(raw[1:start - 1], '[\x22''][A-Za-z0-9+=_-]+$')",
)


# --- bytes -------------------------------------------------------------------------------------------

#: What is put before a unit's text, by its number modulo their count: marks, signatures, nothing.
_PREFIXES = ("EFBBBF", "FFD8FF", "", "7F454C46", "25504446", "1F8B", "4F676753", "00", "504B0304", "89504E470D0A1A0A", "424D", "52494646")


def _contents(spark: SparkSession, d: str) -> DataFrame:
    pick = F.element_at(F.array(*[F.unhex(F.lit(p)) for p in _PREFIXES]), (F.col("unit_seq") % len(_PREFIXES) + 1).cast("int"))
    return units(spark, d).where("text IS NOT NULL").select("unit_seq", F.concat(pick, F.encode("text", "UTF-8")).alias("content"))


_PICK = "CASE unit_seq % 12 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PREFIXES)) + " END"
_CONTENTS = f"{S.UNITS}, raw AS (SELECT unit_seq, text, unhex({_PICK}) || encode(text) AS content FROM units WHERE text IS NOT NULL), hexed AS (SELECT unit_seq, text, hex(content) AS h FROM raw)"
_SIGNED = " OR ".join(f"starts_with(h, '{s.hex().upper()}')" for s in SIGNATURES)
_ENCODING = f"CASE WHEN starts_with(h, 'EFBBBF') THEN 'utf-8-sig' WHEN {_SIGNED} OR regexp_matches(h[1:16384], '^(..)*?00') THEN 'binary' ELSE 'utf-8' END"
register("binary_magic", lambda s, d: _contents(s, d).select("unit_seq", text_encoding(F.col("content")).alias("encoding")), f"WITH {_CONTENTS} SELECT unit_seq, {_ENCODING} AS encoding FROM hexed")
register(
    "bom_decode", lambda s, d: _contents(s, d).select("unit_seq", F.md5(decode_text(F.col("content"))).alias("digest")),
    f"""WITH {_CONTENTS} SELECT unit_seq, CASE {_ENCODING} WHEN 'utf-8-sig' THEN md5(text) WHEN 'utf-8' THEN md5(concat(CASE WHEN unit_seq % 12 = 2 THEN '' END, text)) END AS digest FROM hexed""",
)
