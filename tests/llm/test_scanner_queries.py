import pytest

import __spark_entry__
from sigilite.llm import credentials

TEXTS = [(1, "ok\nCÃ¡lculo de saldo\n"), (2, "x\nmail ana@correio.example\n"), (3, "a = 1\npassword = 'S3gur0!Ab'\n"), (4, None), (3, "a = 1\npassword = 'S3gur0!Ab'\n")]


@pytest.fixture(scope="module")
def d(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t"))
    spark.createDataFrame(TEXTS, "unit_seq bigint, text string").write.parquet(f"{path}/blobs.parquet")
    return path


@pytest.mark.parametrize("name, rows", [("p5_found", [(1,)]), ("p6_found", [(2, 2, "email")]), ("p7_found", [(3, 2)])])
def test_found(spark, d, name, rows):
    assert [tuple(r) for r in __spark_entry__.queries()[name](spark, d).collect()] == rows


@pytest.mark.parametrize("name, unit, text", [("p5_repaired", 1, "ok\nCálculo de saldo\n"), ("p6_redacted", 2, "x\nmail <EMAIL>\n"), ("p7_redacted", 3, "a = 1\npassword = 'S…'\n")])
def test_texts(spark, d, name, unit, text):
    got = __spark_entry__.queries()[name](spark, d).collect()
    assert len(got) == len(TEXTS) and {r.text for r in got if r.unit_seq == unit} == {text}


def test_long_runs_end():
    # each took exponential time
    assert credentials.find("key = " + "a" * 60 + "\n" + "x" * 60 + "!token" + "1" * 60 + " \n") == []
