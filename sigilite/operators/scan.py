"""The scan: units to findings.

Two stages, no shuffle. First a line must pass a rule's gate (a literal it can't match without, then
its pattern); few lines do. Only for those are all matches placed, filtered, freed of overlaps and
redacted, as arrays on the line's own row. The secret itself never leaves this module unless asked for.
"""

from __future__ import annotations

import functools
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigilite.catalog import LONG_RUN, RULES, SEVERITIES, SOFT_IN_TESTS, Config, Rule
from sigilite.functions import text as T
from sigilite.functions import verdicts
from sigilite.operators import lines as L

_HITS = "array<struct<ord:int,start:int,size:int,secret:string>>"


def _gate(raw: Column, rule: Rule, unit_ok: Column) -> Column:
    """Whether a rule matches a line: strings any match must hold, before its pattern runs."""
    out = unit_ok if rule.only_files else F.lit(True)
    if rule.literals:
        out = out & reduce(lambda a, b: a | b, [raw.contains(x) for x in rule.literals])
    if rule.folded:
        out = out & raw.rlike(f"(?Ui)(?:{rule.folded})")
    out = out & raw.rlike(rule.pattern)
    return out & L.has_word(raw, rule.keywords) if rule.keywords else out


def _places(raw: Column, pattern: Column, order: Column) -> Column:
    """All matches of a pattern, left to right, with the offset of the secret.

    The line is split at the matches; lengths of what lies between, before and in them add up to the offsets."""
    whole, before, secret = (F.regexp_extract_all(raw, pattern, F.lit(g)) for g in (0, 1, 2))
    between = F.slice(F.split(raw, pattern, F.lit(-1)), F.lit(1), F.size(whole))
    steps = F.arrays_zip(between.alias("gap"), whole.alias("whole"), before.alias("before"), secret.alias("secret"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_HITS).alias("out"))

    def place(acc: Column, m: Column) -> Column:
        at = acc["at"] + F.length(m["gap"])
        hit = F.struct(order.alias("ord"), (at + F.length(m["before"])).alias("start"), F.length(m["secret"]).alias("size"), m["secret"].alias("secret"))
        return F.struct((at + F.length(m["whole"])).alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

    return F.aggregate(steps, start, place, lambda acc: acc["out"])


def is_pinned(raw: Column, start: Column) -> Column:
    """The secret follows an at-sign: a pinned version or digest."""
    return F.substring(raw, start, F.lit(1)) == "@"


def is_slash_in_quoted(raw: Column, start: Column) -> Column:
    """The slash before the secret lies inside a quoted base64 value, not between parts of a path."""
    return (start >= 2) & (F.substring(raw, start, F.lit(1)) == "/") & F.substring(raw, F.lit(1), start - 1).rlike(r"[\x22'][A-Za-z0-9+=_-]+\z")


def _keeps(raw: Column, rules: list[Rule], digest: Column, h: Column) -> Column:
    """Whether a match that is no placeholder passes the tests of its rule."""
    out = F.lit(True)
    for order, r in enumerate(rules):
        test = None
        if r.min_entropy is not None:
            test = T.shannon_entropy(h["secret"]) >= r.min_entropy
        if r.validator is not None:
            test = r.validator(h["secret"]) if test is None else test & r.validator(h["secret"])
        if test is not None:
            out = F.when(h["ord"] == order, test).otherwise(out)
    random = [order for order, r in enumerate(rules) if r.category == "entropy"]
    if random:
        test = ~digest & ~is_pinned(raw, h["start"]) & ~is_slash_in_quoted(raw, h["start"]) & verdicts.looks_like_secret_token(h["secret"])
        out = out & F.when(h["ord"].isin(random), test).otherwise(True)
    return out


def _any_gate(raw: Column, rules: list[Rule], gates: list[Column]) -> Column:
    """Whether any rule matches; those of vendors' tokens are tried only where their common test passes."""
    either = lambda of: reduce(lambda a, b: a | b, of)
    runs = [g for r, g in zip(rules, gates) if r.long_run]
    rest = [g for r, g in zip(rules, gates) if not r.long_run]
    return either([*([raw.rlike(LONG_RUN) & either(runs)] if runs else []), *rest])


def _stage(rows: DataFrame, *columns) -> DataFrame:
    """A projection that the optimizer leaves as it is: without it, what a stage computes would be copied into
    the filters and projections behind it and evaluated again, for all lines. The partition id isn't a
    deterministic expression, so nothing is moved across it."""
    return rows.select(*columns, F.spark_partition_id().alias("__b")).where("__b >= 0").drop("__b")


def rule_order(rules: tuple[Rule, ...]) -> list[Rule]:
    """The order in which overlapping matches win: severity, then anything before entropy, the broadest entropy rule last, then the id."""
    return sorted(rules, key=lambda r: (-r.rank, r.category == "entropy", r.id == "high-entropy-string", r.id))


def drop_overlaps(hits: Column) -> Column:
    """Hits in order, each kept unless it overlaps one kept before. Lines are of bounded length, hence so is the work."""
    free = lambda kept, h: ~F.exists(kept, lambda k: (h["start"] < k["start"] + k["size"]) & (k["start"] < h["start"] + h["size"]))
    return F.aggregate(F.array_sort(hits), F.array().cast(_HITS), lambda kept, h: F.when(free(kept, h), F.concat(kept, F.array(h))).otherwise(kept))


def redact_spans(raw: Column, hits: Column, keep: int = 4) -> Column:
    """The line with all hits masked, from right to left. A span that isn't where it should be is masked wherever its value occurs."""
    spans = F.reverse(F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["size"].alias("size"), h["secret"].alias("secret")))))

    def put(line: Column, s: Column) -> Column:
        there = (s["start"] + s["size"] <= F.length(line)) & (F.substring(line, s["start"] + 1, s["size"]) == s["secret"])
        masked = F.concat(F.substring(line, F.lit(1), s["start"]), T.redact(s["secret"], keep), F.substring(line, s["start"] + s["size"] + 1, F.length(line)))
        return F.when(there, masked).otherwise(F.replace(line, s["secret"], T.redact(s["secret"], keep)))

    return T.strip(F.aggregate(spans, F.regexp_replace(raw, r"\A[\n\r]+|[\n\r]+\z", ""), put))


@functools.lru_cache(maxsize=64)
def _columns(application: str, config: Config) -> dict[str, Column]:
    """The columns of a scan, which depend on the configuration only. Building them takes seconds, for they have
    thousands of nodes, so it is done once per application and configuration."""
    rules = rule_order(config.active())
    raw, digest = F.col("raw"), F.col("__digest")
    dotenv = next((r.only_files for r in rules if r.id == "dotenv-assignment"), None)
    # a rule with files of its own but other than the environment files tests the name
    ok = {r.id: F.col("dotenv") if r.only_files == dotenv else L.name_matches(F.col("path"), r.only_files, r.not_files) for r in rules if r.only_files}
    gates = [_gate(raw, r, ok.get(r.id, F.lit(True))) for r in rules]
    seen = [F.when(g & ~F.col("__quiet") if r.category == "entropy" else g, F.struct(F.lit(i).alias("ord"), F.lit(r.pattern).alias("pattern"))) for i, (r, g) in enumerate(zip(rules, gates))]
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("h.ord") + 1)
    rank = pick([r.rank for r in rules], "int")
    soft = F.lit(config.demote_tests) & L.is_test_path(F.col("path")) & pick([r.id in SOFT_IN_TESTS for r in rules], "boolean")
    secret = F.col("h.secret")
    return {
        "dotenv": L.is_dotenv(F.col("path"), F.col("text")) if dotenv else F.lit(False),
        "short": F.length(raw) <= config.max_line_length,
        "any": _any_gate(raw, rules, gates),
        "allowed": L.is_allowed(raw, config),
        "quiet": F.col("in_pem") | L.is_payload(raw),
        "digest": L.has_hash_context(raw),
        "seen": F.array_compact(F.array(*seen)),
        "found": F.flatten(F.transform("__seen", lambda r: _places(raw, r["pattern"], r["ord"]))),
        "real": F.filter("__found", lambda h: ~verdicts.looks_like_placeholder(h["secret"])),
        "hits": F.filter("__real", lambda h: _keeps(raw, rules, digest, h)),
        "apart": F.when(F.size("hits") > 1, drop_overlaps(F.col("hits"))).otherwise(F.col("hits")),
        "preview": redact_spans(raw, F.col("hits")),
        "rank": F.when(soft, F.greatest(rank - 1, F.lit(0))).otherwise(rank),
        "severity": F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("severity_rank") + 1),
        "redacted": T.redact(secret),
        "redacted_public": T.redact(secret, 2),
        "entropy": F.bround(T.shannon_entropy(secret), 2),
        **{n: pick([getattr(r, "id" if n == "rule_id" else n) for r in rules], "string") for n in ("rule_id", "title", "category", "cwe", "owasp", "recommendation")},
        "fingerprint": T.fingerprint(F.col("rule_id"), F.col("path"), F.col("redacted")),
    }


_LINE = ("unit_seq", "path", "commit", "line", "raw")


def scan_lines(units: DataFrame, config: Config = Config()) -> DataFrame:
    """Lines with a match: unit columns (unit_seq, path, commit), line, raw, hits and placeholders (matches dropped as such).

    ``units`` needs unit_seq, path and text; commit is optional. Further columns are left out."""
    commit = F.col("commit") if "commit" in units.columns else F.lit(None).cast("string")
    units = units.where("text IS NOT NULL")
    if not config.active():
        rows = L.explode_lines(units.select("unit_seq", "path", commit.alias("commit"), "text"), in_pem=None)
        return rows.where(F.lit(False)).select(*_LINE, F.array().cast(_HITS).alias("hits"), F.lit(0).alias("placeholders"))
    c = _columns(units.sparkSession.sparkContext.applicationId, config)
    rows = L.explode_lines(units.select("unit_seq", "path", commit.alias("commit"), "text", c["dotenv"].alias("dotenv")), in_pem="in_pem")
    # lines that are to be left alone are looked for among the few that pass
    rows = rows.where(c["short"]).where(c["any"]).where(~c["allowed"])
    rows = _stage(rows, *_LINE, "dotenv", c["quiet"].alias("__quiet"), c["digest"].alias("__digest"))
    rows = _stage(rows, *_LINE, "__digest", c["seen"].alias("__seen")).where(F.size("__seen") > 0)
    rows = _stage(rows, *_LINE, "__digest", c["found"].alias("__found"))
    rows = _stage(rows, *_LINE, "__digest", F.size("__found").alias("__n"), c["real"].alias("__real"))
    return _stage(rows, *_LINE, c["hits"].alias("hits"), (F.col("__n") - F.size("__real")).alias("placeholders"))


def scan(units: DataFrame, config: Config = Config(), keep_secret: bool = False) -> DataFrame:
    """The findings of ``units``, one row each, with all that a report shows of them.

    Null texts and units without lines give none; a null path counts as an empty one in the fingerprint.
    Rows listed twice are scanned twice. ``hit_no`` is the place of a finding among those of its line."""
    rows = scan_lines(units, config).where(F.size("hits") > 0)
    if not config.active():
        # no rules: no rows, but the same columns
        return scan(units.where(F.lit(False)), replace(config, rules=RULES, only=frozenset(), skip=frozenset(), skip_categories=frozenset(), use_entropy=True), keep_secret)
    c = _columns(units.sparkSession.sparkContext.applicationId, config)
    keys = _LINE[:4]
    rows = _stage(rows, *_LINE, c["apart"].alias("hits"))
    rows = _stage(rows, *keys, "hits", c["preview"].alias("line_preview"))
    rows = rows.select(*keys, "line_preview", F.posexplode("hits").alias("hit_no", "h")).withColumn("severity_rank", c["rank"])
    named = lambda *names: [c[n].alias(n) for n in names]
    out = rows.select(
        "unit_seq", "hit_no", *named("rule_id", "title", "severity"), "severity_rank", "path", "line", (F.col("h.start") + 1).alias("column_no"), "commit",
        F.lit(1).alias("occurrences"), F.lit(None).cast("string").alias("commit_last"), *named("redacted", "redacted_public", "entropy", "category", "cwe", "owasp", "recommendation"),
        "line_preview", *([F.col("h.secret").alias("secret")] if keep_secret else []),
    )
    return out.withColumn("fingerprint", c["fingerprint"])


def ordered(findings: DataFrame) -> DataFrame:
    """Findings from the most severe, then by path, line, arrival and place in the line: a total order, range-partitioned."""
    return findings.orderBy(F.desc("severity_rank"), "path", "line", "unit_seq", "hit_no")


def long_lines(units: DataFrame, config: Config = Config()) -> DataFrame:
    """(unit_seq, line, n_chars) of the lines too long to be scanned."""
    rows = L.explode_lines(units.select("unit_seq", "text").where("text IS NOT NULL"), in_pem=None)
    return rows.select("unit_seq", "line", F.length("raw").alias("n_chars")).where(F.col("n_chars") > config.max_line_length)
