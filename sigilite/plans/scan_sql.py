"""The scan in DuckDB SQL, written apart from the Spark plan: hits as rows, conditions on neighbours in
place of lookaround (which RE2 lacks), a window for PEM blocks. Used to check the registered queries."""

from __future__ import annotations

from sigilite.catalog import DOTENV_NAMES, HASH_CONTEXT, RULES, SECRET_CONTEXT, SEVERITIES, SENSITIVE, SOFT_IN_TESTS, TUTORIAL_CPF, Config
from sigilite.functions import verdicts as V
from sigilite.functions.taxid import CNPJ_WEIGHTS, CPF_WEIGHTS
from sigilite.operators.scan import rule_order
from sigilite.plans.units import planted_sql

UNITS = f"""units AS (
  SELECT unit_seq, path, text, commit_sha AS commit FROM blobs UNION ALL SELECT * FROM ({planted_sql()})
)"""

#: Patterns without lookaround, where the catalog's have it: (before, secret, after).
_CAMEL = r"[a-z0-9](?:P(?i:assword|asswd|rivate[_-]?key)|S(?i:ecret[_-]?key)|C(?i:lient[_-]?secret)|A(?i:pi[_-]?key|pikey|ccess[_-]?key|uth[_-]?token))"
_PLAIN = {
    "sendgrid-api-key": (r"\b", r"SG\.[0-9A-Za-z_-]{22}\.[0-9A-Za-z_-]{43}", ""),
    "generic-assignment": (rf"(?:(?:^|[^A-Za-z0-9])(?i:{SENSITIVE})|{_CAMEL})[\x22' ]?\s*[:=]\s*[\x22']", r"[^\x22'\n]{8,}", r"[\x22']"),
    "secret-in-path": ("/", "[A-Za-z0-9+_=-]{24,}", ""),
    "dotenv-assignment": (rf"^[ \t]*(?:export[ \t]+)?(?:[A-Za-z0-9_]*_)?(?i:{SENSITIVE})(?:_[A-Za-z0-9_]*)?[ \t]*=[ \t]*", r"[^\s\x22'\n(){}\[\]$;,<>]{8,80}", r"[ \t]*$"),
    "high-entropy-string": ("", "[A-Za-z0-9+/_-]{24,}={0,2}", ""),
}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def contains_any(s: str, parts) -> str:
    return f"regexp_matches({s}, {q(V.any_of(tuple(parts)))})"


# --- measures ---------------------------------------------------------------------------------------


def strip(s: str) -> str:
    return rf"regexp_replace({s}, '^\s+|\s+$', '', 'g')"


def entropy(s: str) -> str:
    return f"(CASE WHEN {s} = '' THEN 0.0 ELSE list_aggregate(string_split({s}, ''), 'entropy') END)"


def corrected(s: str) -> str:
    return f"(CASE WHEN {s} = '' THEN 0.0 ELSE {entropy(s)} + (len(list_distinct(string_split({s}, ''))) - 1) / (2 * length({s}) * ln(2)) END)"


def alphabet(s: str) -> str:
    return f"(CASE WHEN regexp_matches({s}, '^[0-9a-fA-F]*$') THEN 16 WHEN regexp_matches({s}, '^([a-z0-9]*|[A-Z0-9]*)$') THEN 36 ELSE 64 END)"


def high(s: str, least: int = 24) -> str:
    return f"(length({s}) >= {least} AND {corrected(s)} >= 0.8 * log2({alphabet(s)}) - 1e-12)"


def consonants(s: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all(lower({s}), '[bcdfghj-np-tv-z]+'), lambda x: len(x))), 0)"


def classes(s: str) -> str:
    kinds = (r"[\p{Ll}ªº]", r"\p{Lu}", r"\p{Nd}", r"[^\p{L}\p{Nd}]")
    return "(" + " + ".join(f"CAST(regexp_matches({s}, '{k}') AS INTEGER)" for k in kinds) + ")"


def identifier(s: str) -> str:
    parts = rf"list_filter(string_split_regex(regexp_replace({s}, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[_.\-]+'), lambda x: x <> '')"
    words = rf"list_filter({parts}, lambda x: regexp_matches(x, '^\pL{{2,12}}$') AND regexp_matches(x, '[aeiouyAEIOUY]'))"
    return (
        f"(len({parts}) >= 2 AND len({words}) >= 2 AND len({words}) >= len({parts}) - 1 "
        f"AND coalesce(list_sum(list_transform({words}, lambda x: len(x))), 0) * 10 >= length({s}) * 7)"
    )


def url_encoded(s: str) -> str:
    return f"(len(regexp_extract_all({s}, '%[0-9A-Fa-f]{{2}}')) * 30 >= length({s}) * 6)"


def hash_or_id(s: str) -> str:
    return f"regexp_matches({s}, '^([0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}|[0-9a-fA-F]{{40}})$')"


def redacted(s: str, keep: int = 4) -> str:
    t = strip(s)
    return f"(CASE WHEN {t} = '' THEN '' WHEN length({t}) <= {2 * keep + 4} THEN concat({t}[1], '…') ELSE concat({t}[1:{keep}], '…', {t}[-{keep}:]) END)"


def fingerprint(rule: str, path: str, masked: str) -> str:
    return rf"substr(sha256(concat({rule}, chr(0), replace(coalesce({path}, ''), '\', '/'), chr(0), {masked})), 1, 16)"


def tax_number(s: str, weights) -> str:
    d = f"regexp_replace({s}, '[^0-9]', '', 'g')"
    n = len(weights[1]) + 1
    digit = lambda i: f"CAST(nullif({d}[{i}], '') AS INTEGER)"
    tests = []
    for w in weights:
        total = " + ".join(f"{digit(i + 1)} * {x}" for i, x in enumerate(w))
        tests.append(f"{digit(len(w) + 1)} = CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END")
    return f"(CASE WHEN length({d}) = {n} AND replace({d}, {d}[1], '') <> '' THEN {' AND '.join(tests)} ELSE false END)"


# --- verdicts ---------------------------------------------------------------------------------------


def real_password(pw: str) -> str:
    plain = f"({pw} IN {listed(V.URL_PASSWORDS)} OR regexp_matches({pw}, '^x*$') OR {contains_any(pw, V.URL_PASSWORD_PARTS)})"
    return f"(NOT {plain} AND ({high(pw, 12)} OR {classes(pw)} >= 3 OR {consonants(pw)} >= 6))"


_URL = r"(?i)^[a-z][a-z0-9+.\-]*://([^:@/\s]*):([^@/\s]+)@([^/:\s]+)"
_LOGIN = r"(?i)^https?://([^:@/\s]*):([^@/\s]+)@([^/\s?#'\x22]*)"


def example_url(s: str) -> str:
    user, pw, host = (f"lower(regexp_extract({s}, {q(_URL)}, {g}))" for g in (1, 2, 3))
    x = lambda v: f"regexp_matches({v}, '^x*$')"
    host_re = V.EXAMPLE_HOST.replace(r"\A", "^").replace(r"\z", "$")
    return (
        rf"(CASE WHEN NOT regexp_matches({s}, {q(_URL)}) THEN false WHEN regexp_matches({user}, '\{{|%25') OR regexp_matches({pw}, '\{{|%25') THEN true "
        f"WHEN regexp_matches({host}, {q(host_re)}) THEN NOT {real_password(pw)} "
        f"ELSE ({user} IN {listed(V.URL_USERS)} OR {x(user)}) AND ({pw} IN {listed(V.URL_PASSWORDS)} OR {x(pw)} OR {contains_any(pw, V.URL_PASSWORD_PARTS)}) END)"
    )


def obvious_fake(s: str) -> str:
    same = f"(length({s}) >= 8 AND replace({s}, {s}[1], '') = '')"
    return f"({s} IN {listed(V.DOC_EXAMPLES)} OR lower({s}) IN {listed(V.WEAK_VALUES)} OR {same} OR regexp_matches({s}, {q(V.TEMPLATE)}) OR {example_url(s)})"


def placeholder(s: str) -> str:
    return f"({contains_any(f'lower({s})', V.PLACEHOLDER_PARTS)} OR {obvious_fake(s)})"


def secret_value(s: str) -> str:
    return (
        rf"(CASE WHEN regexp_matches({s}, '\s') OR {url_encoded(s)} THEN false WHEN {high(s)} OR regexp_matches({s}, '^[0-9a-fA-F]{{32,}}$') THEN true "
        f"WHEN {placeholder(s)} OR {contains_any(f'lower({s})', V.TEST_PARTS)} THEN false ELSE {classes(s)} >= 3 OR (length({s}) >= 24 AND {consonants(s)} >= 6) END)"
    )


def secret_token(s: str) -> str:
    return f"(length({s}) >= 24 AND NOT {hash_or_id(s)} AND NOT {identifier(s)} AND ({high(s)} OR {consonants(s)} >= 6))"


def login_leaks(s: str) -> str:
    pw, host = f"regexp_extract({s}, {q(_LOGIN)}, 2)", f"regexp_extract({s}, {q(_LOGIN)}, 3)"
    return (
        f"(CASE WHEN NOT regexp_matches({s}, {q(_LOGIN)}) THEN true WHEN {example_url(s)} THEN false "
        f"WHEN length(split_part({host}, ':', 1)) < 4 THEN {high(pw, 12)} ELSE {real_password(pw)} END)"
    )


# --- lines ------------------------------------------------------------------------------------------


def words(raw: str, of) -> str:
    return f"regexp_matches({raw}, {q('(?i)(?:' + '|'.join(of) + ')(?:[^A-Za-z0-9]|$)')})"


def base_name(path: str) -> str:
    return f"string_split({path}, '/')[-1]"


def dotenv_name(path: str) -> str:
    name = f"lower({base_name(path)})"
    return rf"regexp_matches({name}, '^\.env$|^\.env\.|\.env$|^\.envrc$') AND NOT regexp_matches({name}, '\.(example|sample|template|dist)$')"


def dotenv_text(text: str) -> str:
    useful = rf"list_filter(string_split({text}, chr(10))[1:400], lambda x: regexp_matches(x, '\S') AND NOT regexp_matches(x, '^\s*#'))"
    named = rf"list_filter({useful}, lambda x: regexp_matches(x, '^[ \t]*(?:export[ \t]+)?[A-Z_][A-Z0-9_]*=(?:[^\s\x22'']|$)'))"
    return f"(len({useful}) > 0 AND len({named}) * 5 >= len({useful}) * 3)"


def dotenv(path: str = "path", text: str = "text") -> str:
    return f"coalesce(CASE WHEN regexp_matches({path}, '^<[^>]*>$') THEN {dotenv_text(text)} ELSE {dotenv_name(path)} END, false)"


def test_path(path: str = "path") -> str:
    p = rf"replace({path}, '\', '/')"
    name = r"^(test_.*\.py|.*_test\.py|conftest\.py|locustfile\.py|.*\.(test|spec)\.[jt]sx?|test_.*\.(js|ts))$"
    return rf"coalesce(regexp_matches({p}, '(?i)(^|/)(tests|test|__tests__|testing)(/|$)') OR regexp_matches({base_name(p)}, {q('(?i)' + name)}), false)"


LINES = rf"""{UNITS}, split AS (
  SELECT unit_seq, path, commit, text, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM units WHERE text IS NOT NULL
), raws AS (SELECT unit_seq, path, commit, text, CAST(line AS INTEGER) AS line, regexp_replace(l, '\r$', '') AS raw FROM split),
lines AS (
  SELECT unit_seq, path, commit, text, line, raw, coalesce(last_value(CASE WHEN regexp_matches(raw, '^-----BEGIN [A-Z0-9 ]+-----\s*$') THEN true
    WHEN regexp_matches(raw, '^-----END [A-Z0-9 ]+-----\s*$') THEN false END IGNORE NULLS) OVER (PARTITION BY unit_seq ORDER BY line), false) AS in_pem FROM raws
)"""


def allowed(raw: str = "raw") -> str:
    return "(" + " OR ".join(f"contains(lower({raw}), {q(m)})" for m in Config().allow_markers) + ")"


def payload(raw: str = "raw") -> str:
    return rf"regexp_matches({strip(raw)}, '^[A-Za-z0-9+/]{{40,}}={{0,2}}$')"


SEEN = f"{LINES}, seen AS (SELECT * FROM lines WHERE length(raw) <= 4000 AND NOT {allowed()})"


def _hits(rule, order: int) -> str:
    before, secret, after = _PLAIN.get(rule.id, (rule.before, rule.secret, rule.after))
    p = q(f"({before})({secret}){after}")
    size = "list_sum(list_transform({}, lambda x: len(x)))"
    start = f"coalesce({size.format('g[1:i]')}, 0) + coalesce({size.format('w[1:i-1]')}, 0) + len(b[i])"
    where = [f"regexp_matches(raw, {p})"]
    where += [words("raw", rule.keywords)] if rule.keywords else []
    where += [dotenv()] if rule.only_files == DOTENV_NAMES else []
    rows = f"""SELECT unit_seq, path, commit, line, raw, in_pem, {order} AS ord, h.start AS start, h.secret AS secret FROM (
      SELECT *, unnest(list_transform(range(1, len(w) + 1), lambda i: {{'start': {start}, 'secret': s[i]}})) AS h FROM (
        SELECT *, regexp_extract_all(raw, {p}, 0) AS w, regexp_extract_all(raw, {p}, 1) AS b, regexp_extract_all(raw, {p}, 2) AS s, regexp_split_to_array(raw, {p}) AS g FROM seen WHERE {" AND ".join(where)}))"""
    nxt = "substr(raw, CAST(start + length(secret) + 1 AS BIGINT), 1)"
    if rule.id == "sendgrid-api-key":
        rows = f"SELECT * FROM ({rows}) WHERE NOT regexp_matches({nxt}, '[0-9A-Za-z_-]')"
    if rule.id == "secret-in-path":
        rows = rf"SELECT * FROM ({rows}) WHERE {nxt} = '' OR regexp_matches({nxt}, '[/\x22''\s?#]')"
    if rule.id == "high-entropy-string":
        rows = f"SELECT * REPLACE (CASE WHEN secret LIKE '%=' AND regexp_matches({nxt}, '[A-Za-z0-9+/_-]') THEN secret[:-2] ELSE secret END AS secret) FROM ({rows})"
    return rows


def _verdict(rule) -> str | None:
    parts = {
        "basic-auth-url": login_leaks("secret"),
        "generic-assignment": secret_value("secret"),
        "cpf": f"({tax_number('secret', CPF_WEIGHTS)} AND secret NOT IN {listed(TUTORIAL_CPF)})",
        "cnpj": tax_number("secret", CNPJ_WEIGHTS),
        "aws-secret-access-key": f"{entropy('secret')} >= 4.2",
    }
    if rule.category == "entropy":
        slash = r"(start >= 2 AND substr(raw, CAST(start AS BIGINT), 1) = '/' AND regexp_matches(substr(raw, 1, CAST(start - 1 AS BIGINT)), '[\x22''][A-Za-z0-9+=_-]+$'))"
        return f"(NOT in_pem AND NOT {payload()} AND NOT {words('raw', HASH_CONTEXT)} AND coalesce(substr(raw, CAST(start AS BIGINT), 1), '') <> '@' AND NOT {slash} AND {secret_token('secret')})"
    return parts.get(rule.id)


def hits(rules=RULES) -> str:
    """CTEs up to found (all matches with their placeholder verdict) and kept (those that pass)."""
    order = rule_order(tuple(rules))
    rows = "\n    UNION ALL ".join(_hits(r, i) for i, r in enumerate(order))
    tests = [(i, v) for i, r in enumerate(order) if (v := _verdict(r))]
    passes = f"CASE ord {' '.join(f'WHEN {i} THEN {v}' for i, v in tests)} ELSE true END" if tests else "true"
    quiet = [str(i) for i, r in enumerate(order) if r.category == "entropy"]
    shown = f"NOT (ord IN ({', '.join(quiet)}) AND (in_pem OR {payload()}))" if quiet else "true"
    return f"""{SEEN}, found AS (SELECT *, {placeholder('secret')} AS fake FROM (
    {rows}) WHERE {shown}),
  kept AS (SELECT unit_seq, path, commit, line, raw, CAST(ord AS INTEGER) AS ord, CAST(start AS INTEGER) AS start, secret FROM found WHERE NOT fake AND {passes})"""


def findings(rules=RULES) -> str:
    """CTEs up to findings, as the scan gives them."""
    order = rule_order(tuple(rules))
    case = lambda f: "CASE ord " + " ".join(f"WHEN {i} THEN {f(r)}" for i, r in enumerate(order)) + " END"
    soft = [str(i) for i, r in enumerate(order) if r.id in SOFT_IN_TESTS]
    lower = f"ord IN ({', '.join(soft)}) AND {test_path()}" if soft else "false"
    ranks = "CASE severity_rank " + " ".join(f"WHEN {i} THEN {q(s)}" for i, s in enumerate(SEVERITIES)) + " END"
    text = lambda v: "NULL" if v is None else q(v)
    return f"""{hits(rules)}, on_line AS (
    SELECT unit_seq, path, commit, line, raw, list({{'ord': ord, 'start': start, 'size': length(secret), 'secret': secret}} ORDER BY ord, start) AS hs FROM kept GROUP BY ALL
  ), free AS (SELECT *, list_reduce(list_transform(hs, lambda h: [h]), lambda a, b: CASE WHEN len(list_filter(a, lambda k: k.start < b[1].start + b[1].size AND b[1].start < k.start + k.size)) = 0
      THEN list_concat(a, b) ELSE a END) AS fs FROM on_line),
  previews AS (SELECT unit_seq, line, {strip("string_agg(concat(raw[prev + 1:start], masked), '' ORDER BY start) || max_by(raw[start + size + 1:], start)")} AS line_preview FROM (
      SELECT unit_seq, line, raw, f.start AS start, f.size AS size, {redacted('f.secret')} AS masked, coalesce(lag(f.start + f.size) OVER (PARTITION BY unit_seq, line ORDER BY f.start), 0) AS prev
      FROM (SELECT *, unnest(fs) AS f FROM free)) GROUP BY unit_seq, line),
  single AS (SELECT unit_seq, path, commit, line, CAST(no - 1 AS INTEGER) AS hit_no, f.ord AS ord, f.start AS start, f.secret AS secret FROM (SELECT *, unnest(fs) AS f, unnest(range(1, len(fs) + 1)) AS no FROM free)),
  graded AS (SELECT *, CAST(({case(lambda r: r.rank)}) - CASE WHEN {lower} AND ({case(lambda r: r.rank)}) > 0 THEN 1 ELSE 0 END AS INTEGER) AS severity_rank FROM single),
  named AS (SELECT unit_seq, hit_no, {case(lambda r: q(r.id))} AS rule_id, {case(lambda r: q(r.title))} AS title, {ranks} AS severity, severity_rank, path, line, start + 1 AS column_no, commit,
      CAST(1 AS INTEGER) AS occurrences, CAST(NULL AS VARCHAR) AS commit_last, {redacted('secret')} AS redacted, {redacted('secret', 2)} AS redacted_public, round_even({entropy('secret')}, 2) AS entropy,
      {case(lambda r: q(r.category))} AS category, {case(lambda r: text(r.cwe))} AS cwe, {case(lambda r: text(r.owasp))} AS owasp, {case(lambda r: text(r.recommendation))} AS recommendation FROM graded),
  findings_ AS (SELECT n.*, p.line_preview, {fingerprint('n.rule_id', 'n.path', 'n.redacted')} AS fingerprint FROM named n JOIN previews p USING (unit_seq, line))"""
