import io
import json

import pytest

from sigilite import cli
from sigilite.operators import reports as R
from sigilite.sinks import documents as D

GH = "gh" + "p_" + "Zq8vKd3LxWm5RtYp7NcB2HfJ9sGuTe4QaVwX"
SCHEMA = "fingerprint string, rule_id string, path string, line int, severity_rank int, severity string, commit string, unit_seq bigint, redacted_public string"


@pytest.fixture(scope="module")
def found(spark):
    rows = [
        ("F1", "r", "a", 1, 3, "high", "c1", 1, "x"), ("F1", "r", "a", 1, 3, "high", "c2", 2, "x"), ("F1", "r", "a", 5, 3, "high", "c3", 3, "x"),
        ("f2", "s", "b", 9, 4, "critical", None, 4, "y"), (None, "t", None, None, 1, "low", None, 5, "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_counts(found):
    assert {r.severity: r.n for r in R.severity_counts(found).collect()} == {"info": 0, "low": 1, "medium": 0, "high": 3, "critical": 1}
    assert R.max_severity(found).first().severity == "critical" and R.max_severity(found.limit(0)).first().severity is None
    assert [R.exit_code(f, x).first()[0] for f, x in ((found, "medium"), (found, "none"), (found.limit(0), "info"))] == [1, 0, 0]


def test_collapse(found):
    got = {r.fingerprint: (r.line, r.commit, r.occurrences, r.commit_last) for r in R.collapse(found).collect()}
    assert got == {"F1": (1, "c1", 3, "c3"), "f2": (9, None, 1, None), None: (None, None, 1, None)}


def test_numbering_is_total(spark, found):
    assert sorted((r.position, r.unit_seq) for r in R.numbered(found).collect()) == [(1, 4), (2, 1), (3, 2), (4, 3), (5, 5)]
    assert [r.unit_seq for r in R.top_plan(found).collect()] == [4, 1, 2]


def test_baseline(spark, found):
    old = spark.createDataFrame([("f1",), ("f1",), (None,)], "fingerprint string")
    assert sorted(r.unit_seq for r in R.new_findings(found, old).collect()) == [4, 5]
    assert R.suppressed_count(found, old).first()[0] == 3


def test_evaluation(spark):
    labels = spark.createDataFrame([("p\\a", 10), ("p/b", 5), ("p/c", 1)], "path string, line int")
    found = spark.createDataFrame([("p/a", 11), ("p/a", 9), ("p/b", 7), (None, None)], "path string, line int")
    got = R.evaluation(labels, found).first()
    assert (got.labels, got.found, got.missed, got.findings, got.unlabelled) == (3, 1, 2, 4, 2)
    assert got.recall == pytest.approx(1 / 3) and got.precision == 0.5 and got.recall_low < 1 / 3 < got.recall_high


@pytest.fixture
def project(tmp_path):
    (tmp_path / "a.py").write_text(f"x = '{GH}'\n")
    (tmp_path / "b.txt").write_text("nothing\n")
    return tmp_path


def run(spark, *argv):
    out, err = io.StringIO(), io.StringIO()
    return cli.main(list(argv), spark, out, err), out.getvalue(), err.getvalue()


def test_cli(spark, project):
    code, text, _ = run(spark, "scan", str(project))
    assert code == 1 and "github-token" in text and GH not in text
    assert run(spark, "scan", str(project), "--fail-on", "critical")[0] == 0
    assert run(spark, "scan", str(project / "b.txt"))[0] == 0
    code, _, err = run(spark, "scan", str(project), "--only", "nope")
    assert code == 2 and "github-token" in err
    assert run(spark, "scan", str(project), "-o", "x")[0] == 2
    assert run(spark, "scan", str(project / "none"))[0] == 2
    assert run(spark, "scan", "--git-history", str(project))[0] == 2
    assert run(spark, "rules")[1].count("\n") == 28


def test_documents(spark, project):
    code, text, _ = run(spark, "scan", str(project), "-f", "json")
    doc = json.loads(text)
    assert doc["summary"]["total"] == 1 and doc["summary"]["units_scanned"] == 2 and set(doc["findings"][0]) >= {"id", "column", "fingerprint"} and len(doc["findings"][0]) == 17
    assert doc["artifact_sha256"] == D.canonical_sha256({**doc, "artifact_sha256": None}) and GH not in text
    sarif = run(spark, "scan", str(project), "-f", "sarif", "-o", str(project / "out.sarif"))[1]
    doc = json.loads((project / "out.sarif").read_text())
    assert sarif == "" and len(doc["runs"][0]["tool"]["driver"]["rules"]) == 28 and doc["runs"][0]["results"][0]["level"] == "error"
    assert GH[:4] not in json.dumps(doc["runs"][0]["results"])


def test_baseline_file(spark, project):
    file = str(project / "accepted.json")
    assert run(spark, "scan", str(project), "--update-baseline", file)[0] == 0
    entry = next(iter(json.load(open(file))["findings"].values()))
    assert entry["rule"] == "github-token" and entry["redacted"] == "gh…wX"
    assert run(spark, "scan", str(project / "a.py"), "--baseline", file)[0] == 0
    assert run(spark, "scan", str(project / "a.py"), "--baseline", file + ".none")[0] == 1  # a missing file accepts nothing
    (project / "bad.json").write_text("[]")
    assert run(spark, "scan", str(project / "a.py"), "--baseline", str(project / "bad.json"))[0] == 2


def test_hashes():
    from dataclasses import replace

    from sigilite.catalog import RULES

    other = (replace(RULES[0], secret="x"), *RULES[1:])
    assert D.ruleset_hash() == D.ruleset_hash(other) and D.pattern_hash() != D.pattern_hash(other)
