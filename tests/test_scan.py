import pytest

from sigilite.catalog import RULES, Config, Rule
from sigilite.operators.lines import explode_lines

A = "Zq8vKd3LxWm5RtYp7NcB2HfJ9sGuTe4QaVwXyMnb"  # 40 letters and digits
HEX = "0123456789abcdef" * 4
GH = "gh" + "p_" + A[:36]
PEM = "-----BEGIN RSA " + "PRIVATE KEY-----"

POSITIVE = {
    "private-key": PEM, "aws-access-key-id": "k = 'AK" + "IA" + "Q3EGTRHJ5LKMNPZ7'", "aws-secret-access-key": f"aws_secret = '{A}'", "github-token": GH,
    "github-pat-fine-grained": "github" + "_pat_" + A, "gitlab-pat": "gl" + "pat-" + A[:20], "npm-token": "np" + "m_" + A[:36], "google-api-key": "AI" + "za" + A[:35],
    "slack-token": "xo" + "xb-" + A[:24], "slack-webhook": "https://hooks." + "slack.com/services/T1/B2/" + A[:20], "sendgrid-api-key": "S" + "G." + A[:22] + "." + A + "abc",
    "twilio-api-key": "S" + "K" + HEX[:32], "digitalocean-token": "do" + "p_v1_" + HEX, "huggingface-token": "h" + "f_" + A[:36],
    "mercadopago-access-token": "APP" + "_USR-12345-010203-" + HEX[:32] + "-9", "stripe-secret-key": "sk_" + "live_" + A[:30], "shopify-token": "shp" + "at_" + HEX[:32],
    "doppler-token": "dp" + ".pt." + A + "abc", "linear-api-key": "lin" + "_api_" + A, "jwt": "ey" + "J" + A[:20] + ".ey" + "J" + A[:20] + "." + A,
    "db-connection-uri": f"redis://:{A[:14]}@db1.host.io:6379/0", "basic-auth-url": f"https://bot:{A[:14]}@git.host.io/x", "generic-assignment": 'db_password = "Cliente#1234"',
    "secret-in-path": f"GET /hook/{A[:32]}/run", "dotenv-assignment": "API_KEY=" + A[:20], "high-entropy-string": "bearer " + A, "cpf": "529.982.247-25", "cnpj": "11.222.333/0001-81",
}
NEGATIVE = (
    "password = os.environ['X']", "token = get_token()", 'secret = "changeme"', 'password = "${DB_PASSWORD}"', "monkey = 1", "etag key " + A, "uses: key/action@" + A,
    f'opaque = "{A[:12]}/{A[:30]}"', "http://user:password@localhost/", "key " + HEX[:40], "nextSignificantToken = 'abcdefgh12#A'", "529.982.247-24", "123.456.789-" + "09",
)


def test_every_rule_has_an_example():
    assert POSITIVE.keys() == {r.id for r in RULES}


def test_examples(scan_texts):
    ids = list(POSITIVE)
    rows = scan_texts(*[(".env" if i == "dotenv-assignment" else f"src/{i}.py", POSITIVE[i]) for i in ids])
    assert {(ids[r.unit_seq]) for r in rows if r.rule_id == ids[r.unit_seq]} == set(ids)
    assert [r.severity_rank for r in rows] == sorted((r.severity_rank for r in rows), reverse=True)


def test_counterexamples(scan_texts):
    assert [(NEGATIVE[r.unit_seq], r.rule_id) for r in scan_texts(*[("src/x.py", t) for t in NEGATIVE])] == []


def test_overlap_keeps_the_vendor(scan_texts):
    assert [r.rule_id for r in scan_texts(("a.py", "token " + GH))] == ["github-token"]


def test_preview_hides_all_secrets(scan_texts):
    other = "gh" + "o_" + A[4:40]
    rows = scan_texts(("a.py", f"x {GH} {other} {GH}"))
    assert len(rows) == 3 and {r.line_preview for r in rows} == {"x ghp_…eTe4 gho_…VwXy ghp_…eTe4".replace("eTe4", GH[-4:]).replace("VwXy", other[-4:])}
    assert [r.column_no for r in rows] == [3, 44, 85]
    assert all(GH not in str(v) for r in rows for v in r if v is not None)


def test_secret_only_on_demand(scan_texts):
    assert "secret" not in scan_texts(("a.py", GH))[0].asDict() and scan_texts(("a.py", GH), keep_secret=True)[0].secret == GH


def test_key_names(scan_texts):
    cases = {"DB_PASSWORD": 1, "JWT_SECRET": 1, "clientApiKey": 1, "password": 1, "passwordHash": 0, "nextToken": 0, "monkey": 0, "mypwd": 0, "x-api-key": 1}
    rows = scan_texts(*[("a.py", f'{k} = "Cliente#1234"') for k in cases])
    assert {list(cases)[r.unit_seq] for r in rows} == {k for k, v in cases.items() if v}


def test_tests_weigh_less(scan_texts):
    line = 'password = "Cliente#1234"'
    got = {r.path: r.severity for r in scan_texts(("app/config.py", line), ("tests/config.py", line), ("src\\test_x.py", line))}
    assert got == {"app/config.py": "medium", "tests/config.py": "low", "src\\test_x.py": "low"}
    assert {r.severity for r in scan_texts(("tests/config.py", line), config=Config(demote_tests=False))} == {"medium"}


def test_dotenv(scan_texts):
    line = "SECRET_KEY=" + "Cliente1234#"
    units = [(p, line) for p in (".env", "x/producao.env", "settings.py", ".env.example", "<loose object 1>")] + [("<loose object 2>", "a = 1\nb = 2\n" + line)]
    assert {r.unit_seq for r in scan_texts(*units) if r.rule_id == "dotenv-assignment"} == {0, 1, 4}


def test_pem_bodies_are_quiet(scan_texts):
    body = f"{PEM}\nkey /{A[:32]}/x\n{GH}\n" + PEM.replace("BEGIN", "END") + f"\nkey /{A[:32]}/x\n"
    assert [(r.rule_id, r.line) for r in scan_texts(("k.pem", body))] == [("private-key", 1), ("github-token", 3), ("secret-in-path", 5)]


def test_allowed_and_long_lines(scan_texts):
    assert scan_texts(("a.py", GH + "  # pragma: allowlist secret"), ("b.py", GH + " " + "y" * 4000)) == []


def test_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nb\x0cc\x85d\n\ne"), (2, ""), (3, None), (4, "x\r\r\n")], "unit_seq int, text string")
    got = [(r.unit_seq, r.line, r.raw) for r in explode_lines(df).orderBy("unit_seq", "line").collect()]
    assert got == [(1, 1, "a"), (1, 2, "b\x0cc\x85d"), (1, 3, ""), (1, 4, "e"), (2, 1, ""), (4, 1, "x\r"), (4, 2, "")]


def test_pem_state(spark):
    text = "a\n-----BEGIN X-----\nb\n-----BEGIN Y-----\nc\n-----END X-----\nd\n-----BEGIN Z----- \nlast"
    df = spark.createDataFrame([(1, text), (2, "-----BEGIN A-----"), (3, "no -----BEGIN A-----\nx")], "unit_seq int, text string")
    got = {(r.unit_seq, r.line) for r in explode_lines(df).where("in_pem").collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (1, 5), (1, 8), (1, 9), (2, 1)}
    assert sorted(r.line for r in explode_lines(df).where("unit_seq = 1").collect()) == list(range(1, 10))


def test_selection(scan_texts):
    text = f"{GH}\n529.982.247-25\nbearer {A}"
    ids = lambda c: [r.rule_id for r in scan_texts(("a.py", text), config=c)]
    assert ids(Config(only=frozenset(["cpf"]))) == ["cpf"]
    assert ids(Config(use_entropy=False, skip_categories=frozenset(["pii"]))) == ["github-token"]
    assert Config(only=frozenset(["nope"])).unknown == ("nope",)
    assert ids(Config(rules=())) == []
    with pytest.raises(ValueError):
        Config(rules=(RULES[0], RULES[0]))


def test_own_rule(scan_texts):
    mine = Rule("ticket", "low", r"TCK-\d{6}", r"\b", r"\b", ("TCK-",), validator=lambda s: ~s.endswith("000000"))
    assert [r.redacted for r in scan_texts(("a.txt", "TCK-123456 TCK-000000"), config=Config().with_rules(mine))] == ["T…"]


def test_nulls_copies_and_extra_columns(spark):
    from sigilite.operators.scan import scan

    rows = [(1, None, GH, "x"), (1, None, GH, "x"), (2, "a", None, "y"), (3, "b", "", None)]
    df = spark.createDataFrame(rows, "unit_seq bigint, path string, text string, line string")
    got = scan(df).collect()
    assert [(r.unit_seq, r.path, r.line, r.rule_id) for r in got] == [(1, None, 1, "github-token")] * 2
    assert scan(df.limit(0)).count() == 0


def test_long_text(scan_texts):
    text = "\n".join(["x = 1"] * 200_000 + [GH])
    assert [r.line for r in scan_texts(("a.py", text))] == [200_001]


def test_no_shuffle(spark):
    from sigilite.operators.scan import scan

    df = spark.createDataFrame([(1, "a", GH)], "unit_seq bigint, path string, text string")
    assert "Exchange" not in scan(df)._jdf.queryExecution().executedPlan().toString()
