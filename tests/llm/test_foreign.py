from sigilite.llm import foreign
from sigilite.llm.foreign import foreign_units, masked, plain_evidence, validate

OWN = "import os\n\n\ndef total(rows, limit=3):\n    # adds what is open\n    return sum(r.value for r in rows if r.open)\n"
MADE = "// Code generated by maker. DO NOT EDIT.\n" + "".join(f"func (x *Row) GetA{i}() int32 {{ return x.a{i} }}\n" for i in range(20))
MINI = "function a(b){return b&&b.c>4?a(b):b};" * 20
DATA = "T = [\n" + "    12, 345, 6789, 10, 11,\n" * 40 + "]\n"


def test_evidence():
    assert plain_evidence("app/x.go", MADE) == "generated"
    assert plain_evidence("vendor/lib/x.py", OWN) == "vendored"
    assert plain_evidence("lib/x.py", "# x 1.0\n# Copyright (c) 2020 the x contributors\n" + OWN) == "vendored"
    assert plain_evidence("web/x.min.js", MINI) == "minified"
    assert plain_evidence("src/x.py", DATA) == "data"
    assert plain_evidence("src/x.py", OWN) is None
    # own code that writes such files
    assert plain_evidence("tools/gen.py", OWN + '\nHEADER = "# Code generated by maker. DO NOT EDIT."\n') is None


def test_masking():
    path, text = masked("ext/vendor/lib/x.go", MADE)
    assert plain_evidence(path, text) is None and text.count("\n") == MADE.count("\n")


def _rows(n):
    rows = []
    for i in range(n):
        rows += [(f"r{i}/src/own_{i}.py", OWN.replace("total", f"total_{i}")), (f"r{i}/app/x{i}.go", MADE.replace("maker", f"maker{i}")), (f"r{i}/vendor/lib/y{i}.py", "# lib\n" + OWN.replace("open", f"shut{i}"))]
        rows += [(f"r{i}/web/z{i}.js", MINI.replace("4", str(i))), (f"r{i}/src/t{i}.py", DATA.replace("345", str(i)))]
    return rows


def test_held_out_repositories():
    got = validate([(p, t, plain_evidence(p, t)) for p, t in _rows(30)])
    assert got["recall"] >= 0.9 and got["precision"] >= 0.9


def test_units(spark):
    rows = [(i, p, t) for i, (p, t) in enumerate(_rows(12))]
    want = {i for i, p, t in rows if plain_evidence(p, t)}
    rows += [(1000, "docs/generated.md", MADE), (1001, None, None), (1002, None, ""), (None, "r0/src/own.py", OWN), (0, *rows[0][1:])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "unit_seq bigint, path string, text string, kind int")
    assert {r.unit_seq for r in foreign_units(df).collect()} == want
    assert foreign_units(df.limit(0)).count() == 0
    # one class only
    assert foreign_units(df.where("path like '%own%'")).count() == 0


def test_sample_is_bounded():
    assert foreign.SAMPLE <= 10_000
