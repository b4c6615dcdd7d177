"""The units the registered queries scan: all blobs, and one planted unit per order.

Planted units exercise every rule and operator at any scale. Their text is one SQL expression over the
order key that Spark and other engines evaluate alike; vendors' prefixes are put together from parts,
so that no whole token stands in this file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigilite.session import spread, table

#: Added to order keys, so that planted units and blobs don't share numbers.
PLANTED = 10_000_000_000


#: Letters and digits each planted unit draws from.
_POOL = 198


def _hex(tag: str, n: int = 32) -> str:
    return f"substr(hexes, 1, {n})"


def _b62(tag: str, n: int) -> str:
    """n letters and digits of both cases: a window of the unit's own pool."""
    return f"substr(pool, {sum(map(ord, tag)) * 37 % (_POOL - n) + 1}, {n})"


def _check(base: str, weights: list[int]) -> str:
    total = " + ".join(f"cast(substr({base}, {i + 1}, 1) as int) * {w}" for i, w in enumerate(weights))
    return f"(case when ({total}) % 11 < 2 then 0 else 11 - ({total}) % 11 end)"


def planted_sql(orders: str = "orders", lazily: str = "{}") -> str:
    """SELECT unit_seq, path, text, commit, in SQL that Spark and DuckDB share. ``lazily`` wraps the text, which is
    too long an expression for generated code."""
    from sigilite.functions.taxid import CNPJ_WEIGHTS, CPF_WEIGHTS

    nl, q, num = "chr(10)", "chr(34)", "cast(o_orderkey as varchar(20))"
    line = lambda *p: f"concat({', '.join(p)})"
    b = _b62
    texts = [
        line("'-----BEGIN RSA '", "'PRIVATE KEY-----'", nl, b("k1", 64), nl, b("k2", 64), nl, "'-----END RSA '", "'PRIVATE KEY-----'"),
        line("'id = '", q, "'AK'", "'IA'", f"upper({b('aw', 16)})", q),
        line("'aws_'", "'secret = '", q, b("as", 40), q),
        line("'x '", "'gh'", "'p_'", b("gh", 36), "' y'"),
        line("'github'", "'_pat_'", b("gp", 40)),
        line("'run gl'", "'pat-'", b("gl", 20), "';'"),
        line("'np'", "'m_'", b("np", 36)),
        line("'AI'", "'za'", b("ai", 35)),
        line("'xo'", "'xb-'", b("xo", 24)),
        line("'post https://hooks.'", "'slack.com/services/T'", b("s1", 9), "'/B'", b("s2", 9), "'/'", b("s3", 20)),
        line("'S'", "'G.'", b("g1", 22), "'.'", b("g2", 43)),
        line("'S'", "'K'", _hex("tw")),
        line("'do'", "'p_v1_'", _hex("do", 64)),
        line("'h'", "'f_'", b("hf", 36)),
        line("'APP_'", "'USR-12345678-012345-'", _hex("mp"), "'-99'"),
        line("'sk_'", "'live_'", b("sk", 30)),
        line("'shp'", "'at_'", _hex("sh")),
        line("'dp.'", "'pt.'", b("dp", 43)),
        line("'lin_'", "'api_'", b("li", 40)),
        line("'ey'", "'J'", b("j1", 20), "'.ey'", "'J'", b("j2", 30), "'.'", b("j3", 40)),
        line("'url = postgresql+psycopg://app:'", b("db", 18), "'@db7.host.internal:5432/base'"),
        line("'mirror https://bot:'", b("ba", 18), "'@git.host.internal/x.git'"),
        line("'db_password = '", q, b("ga", 18), "'#4'", q, nl, "'camelApiKey: '", q, b("gb", 20), q, nl, "'token: '", q, "'wrong value'", q),
        line("'GET /hooks/'", b("sp", 32), "'/run'"),
        line("'DB_PASSWORD='", b("de", 20), nl, "'MODE=prod'", nl, "'# note'"),
        line("'bearer '", b("he", 40), "'=='"),
        line("'doc '", "substr(base, 1, 3)", "'.'", "substr(base, 4, 3)", "'.'", "substr(base, 7, 3)", "'-'", "p1", "p2", "' and 123.456.789-'", "'09 and 111.222.333-44'"),
        line("'doc '", "substr(firm, 1, 2)", "'.'", "substr(firm, 3, 3)", "'.'", "substr(firm, 6, 3)", "'/'", "substr(firm, 9, 4)", "'-'", "c1", "c2"),
        # what operators rather than rules are about
        line("'secret = '", q, "'example-'", b("pl", 20), q, nl, "'password = '", q, "'changeme'", q, nl, "'token = '", q, "'${TOKEN_'", num, "'}'", q),
        line("'x gh'", "'p_'", b("al", 36), "' # pragma: allowlist secret'"),
        line("'-----BEGIN CERTIFICATE-----'", nl, b("c1", 64), nl, "'key /'", b("c2", 30), "'/x'", nl, "'-----END CERTIFICATE-----'", nl, "'key /'", b("c3", 30), "'/x'"),
        line("'token '", b("lo", 30), "rpad(' x', 4100, 'y')", nl, "'token '", b("ls", 30)),
        line("'key '", "'gh'", "'p_'", b("t1", 36), "' '", "'gh'", "'p_'", b("t2", 36), "' '", "'gh'", "'p_'", b("t1", 36)),
        line("'uses: key/action@'", b("pi", 40)),
        line("'opaque key = '", q, b("o1", 12), "'/'", b("o2", 30), q),
        line("'etag key '", b("ha", 40), nl, "'auth id '", _hex("hu", 40)),
        line("'token '", b("bl", 40), nl, b("bm", 60), "'=='"),
        line("'mirror http://user:password@localhost/x'", nl, "'db redis://:'", b("rd", 14), "'@10.0.0.7:6379/0'", nl, "'u https://me:Aa1!'", b("re", 3), "'@ab/x'"),
        line("'key: token_'", "'refresh_policy_name_'", "'of_the_service'", nl, "'monkey '", b("mk", 32)),
        line("'senha e nada mais '", num),
    ]
    paths = {
        24: "case o_orderkey % 3 when 0 then concat('app/.env.', {n}) when 1 then '<objeto solto 0a1b>' else concat('app/', {n}, '.env.example') end",
        22: "case o_orderkey % 2 when 0 then concat('tests/test_', {n}, '.py') else concat('src\\mod_', {n}, '.py') end",
        25: "case o_orderkey % 2 when 0 then concat('app/__tests__/', {n}, '.js') else concat('src/', {n}, '.js') end",
    }
    kinds = len(texts)
    path = " ".join(f"when {k} then {p.format(n=num)}" for k, p in paths.items())
    text = " ".join(f"when {k} then {t}" for k, t in enumerate(texts))
    cpf, cnpj = CPF_WEIGHTS, CNPJ_WEIGHTS
    part = "translate(base64(unhex(md5(concat('{}:', o_orderkey)))), '+/=', 'pq')"
    pool = "concat(" + ", ".join(part.format(i) for i in range(_POOL // 22)) + ")"
    return f"""
SELECT {PLANTED} + o_orderkey AS unit_seq, case kind {path} else concat('src/unit_', {num}, '.txt') end AS path, {lazily.format(f'(case kind {text} end)')} AS text,
  substr(md5(concat('commit:', o_orderkey % 97)), 1, 12) AS commit
FROM (SELECT *, {_check("concat(base, p1)", cpf[1])} AS p2, {_check("concat(firm, c1)", cnpj[1])} AS c2
  FROM (SELECT *, {_check("base", cpf[0])} AS p1, {_check("firm", cnpj[0])} AS c1
    FROM (SELECT o_orderkey, {pool} AS pool, concat(md5(concat('x:', o_orderkey)), md5(concat('y:', o_orderkey))) AS hexes, o_orderkey % {kinds} AS kind, lpad(cast(o_orderkey * 7919 % 1000000000 as varchar(20)), 9, '0') AS base,
      concat(lpad(cast(o_orderkey * 104729 % 100000000 as varchar(20)), 8, '1'), '0001') AS firm FROM {orders}) a) b) c"""


def units(spark: SparkSession, d: str) -> DataFrame:
    """(unit_seq, path, text, commit) of all blobs and all planted units."""
    table(spark, d, "orders").select("o_orderkey").createOrReplaceTempView("__sigilite_orders")
    planted = spark.sql(planted_sql("__sigilite_orders", "transform(array(0), i -> {})[0]"))
    # out of a generator, so that the planted expressions aren't copied into every test on them
    planted = planted.select(F.inline(F.array(F.struct("unit_seq", "path", "text", "commit"))))
    blobs = table(spark, d, "blobs").select("unit_seq", "path", "text", F.col("commit_sha").alias("commit"))
    return spread(blobs).unionByName(spread(planted))


def units_from_table(df: DataFrame, key: str, text: str, path: str | None = None, commit: str | None = None) -> DataFrame:
    """Any table with a text column as units; without a path column the key is the path. Extra columns are dropped."""
    name = F.col(path) if path else F.col(key).cast("string")
    ref = F.col(commit) if commit else F.lit(None)
    return df.select(F.col(key).cast("long").alias("unit_seq"), name.alias("path"), F.col(text).alias("text"), ref.cast("string").alias("commit"))
