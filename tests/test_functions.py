import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigilite.functions import taxid
from sigilite.functions import text as T
from sigilite.functions import verdicts as V


@pytest.fixture(scope="module")
def value(spark):
    def run(column, *strings):
        df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string").coalesce(1)
        return [r[0] for r in df.orderBy("i").select(column(F.col("s"))).collect()]

    return run


def test_entropy(value):
    assert value(T.shannon_entropy, "", "aaaa", "abcd", None) == [0.0, 0.0, 2.0, None]
    assert value(T.corrected_entropy, "abcd")[0] == pytest.approx(2 + 3 / (8 * math.log(2)))
    assert value(T.alphabet_size, "deadBEEF01", "abc123z", "ABC123Z", "aB+/") == [16, 36, 36, 64]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=40), min_size=20, max_size=40))
def test_entropy_equals_its_definition(spark, strings):
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    for s, got in df.select("s", T.shannon_entropy(F.col("s"))).collect():
        p = [s.count(c) / len(s) for c in set(s)]
        assert got == pytest.approx(-sum(x * math.log2(x) for x in p), abs=1e-9)


def test_shapes(value):
    assert value(T.consonant_run, "encrypted", "aeiou", "XKCDQ", "") == [6, 0, 5, 0]
    assert value(T.char_classes, "abc", "aB1#", "ção1", "") == [1, 4, 2, 0]
    assert value(T.is_code_identifier, "cert_encrypted_private_key_file", "xK7mP9_q", "getUserByEmail", "word") == [True, False, True, False]
    assert value(T.is_url_encoded, "%F0%9F%92%A9", "pa%20ss") == [True, False]
    assert value(T.is_hash_or_id, "a" * 40, "a" * 32, "12345678-1234-1234-1234-123456789abc") == [True, False, True]
    long = "Zq8vKd3LxWm5RtYp7NcB2HfJ"
    assert value(T.is_high_entropy, long, long[:-1], "a" * 24) == [True, False, False]


def test_redaction(value):
    assert value(T.redact, "", "  ", "abcdefghijkl", "abcdefghijklm", " abcdefghijklmnop\n") == ["", "", "a…", "abcd…jklm", "abcd…mnop"]
    assert value(lambda s: T.redact(s, 2), "abcdefghi") == ["ab…hi"]


def test_tax_numbers(value):
    assert value(taxid.cpf_valid, "529.982.247-25", "529.982.247-24", "111.111.111-11", "1", None) == [True, False, False, False, None]
    assert value(taxid.cnpj_valid, "11.222.333/0001-81", "11.222.333/0001-80", "00.000.000/0000-00") == [True, False, False]


def test_placeholders(value):
    assert value(V.looks_like_placeholder, "changeme", "x" * 8, "${TOKEN}", "{{ v }}", "<api-key>", "my-EXAMPLE-key", "Zq8vKd3L") == [True] * 6 + [False]
    assert value(V.is_example_url, "http://user:pass@host.io/", "http://app:Zq8vKd3LxW#1@localhost/", "http://u:{PW}@host.io", "no url") == [True, False, True, False]
    assert value(V.password_looks_real, "changeme", "xxxx", "Aa1!", "mysecret", "postgres") == [False, False, True, False, False]
    assert value(V.looks_like_secret_value, "wrong password", "%F0%9F%92%A9", "Brasil@2024", "senha-Teste-1", "d" * 16 + "0" * 16, "monitoring_password") == [False, False, True, False, True, False]


def test_wilson(spark):
    low, high = spark.range(1).select(T.wilson(F.lit(13), F.lit(14)).alias("w")).select("w.*").first()
    assert (round(low, 2), round(high, 2)) == (0.69, 0.99)
    assert tuple(spark.range(1).select(T.wilson(F.lit(0), F.lit(0)).alias("w")).select("w.*").first()) == (0.0, 0.0)
