import numpy as np
import pandas as pd
import pytest

from sigilite.llm import splitting, tokens
from sigilite.llm.mixing import mix, rake
from sigilite.llm.splitting import split_oversized


def test_raking_meets_sources_and_limits():
    rng = np.random.RandomState(0)
    cells = pd.DataFrame([(s, l, t, float(rng.randint(50, 500))) for s in "abc" for l in ("pt", "en") for t in "xyz"], columns=["source", "__lang", "__topic", "n_tokens"])
    own = cells.groupby("source")["n_tokens"].sum()
    w = rake(cells, {"a": own["a"] * 1.5, "b": own["b"] * 0.5, "c": own["c"] * 9}, {"a": 2, "b": 1, "c": 3})
    got = (w * cells["n_tokens"]).groupby(cells["source"]).sum()
    assert got["a"] == pytest.approx(own["a"] * 1.5) and got["b"] == pytest.approx(own["b"] * 0.5) and got["c"] == pytest.approx(own["c"] * 3)
    assert (w <= cells["source"].map({"a": 2, "b": 1, "c": 3}) + 1e-9).all()


def test_mix(spark):
    words = "palavra numero texto origem nota "
    docs = [(i, words * (1 + i % 9), "pt", "big", "o/p") for i in range(400)] + [(1000 + i, words * 3, None, "small", None) for i in range(10)]
    docs += [(2000, None, "en", "big", "o/q"), (2001, "", "en", "big", None), (2002, words, "en", None, None), (None, words, "en", "other", None)]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, repo string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("none", 0.2, 2)], "source string, target_share double, max_uses int")
    drawn, shares = mix(documents, targets)
    got = {r.source: r for r in shares.collect()}
    assert (got["small"].status, got["none"].status, got["big"].status) == ("capped", "missing", "raised")
    assert sum(r.reached_share for r in got.values()) == pytest.approx(1)
    assert abs(got["big"].reached_tokens / got["big"].target_tokens - 1) < 0.02
    rows = drawn.collect()
    assert all(r.n_uses <= {"big": 1, "small": 4}[r.source] for r in rows) and {r.n_uses for r in rows if r.source == "small"} == {4}
    drawn, shares = mix(documents.limit(0), targets)
    assert drawn.count() == 0 and {r.status for r in shares.collect()} == {"missing"}


def test_pieces(spark):
    texts = ["# A\n" + "Uma frase curta. " * 900, "x" * 30_000, "日本語テキスト" * 1500, "linha\n" * 4000, "curto", "", None, "😀" * 4000]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, piece int")
    rows = sorted(split_oversized(df).collect(), key=lambda r: (r.doc_id, r.piece))
    enc = tokens.encoding()
    for i in {r.doc_id for r in rows}:
        own = [r for r in rows if r.doc_id == i]
        assert [r.piece for r in own] == list(range(len(own)))
        assert own[0].start_token == 0 and own[-1].end_token == tokens.count(texts[i])
        assert all(a.end_token - b.start_token == 128 for a, b in zip(own, own[1:]))
        assert all(len(enc.encode_ordinary(r.text)) <= 2048 for r in own)
        assert own[0].text == texts[i][: len(own[0].text)] and texts[i].endswith(own[-1].text)
    assert {r.doc_id for r in rows} == {i for i, t in enumerate(texts) if t and tokens.count(t) > 2048}
    assert all(r.text.endswith("\n") for r in rows if r.doc_id == 3)


def test_many_pieces(spark, monkeypatch):
    # more pieces than are summed up at a time
    monkeypatch.setattr(splitting, "BLOCK", 4)
    text = "palavra outra " * 2000
    rows = sorted(split_oversized(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), limit=128, overlap=16).collect(), key=lambda r: r.piece)
    assert len(rows) > 30 and rows[-1].end_token == tokens.count(text) and all(a.end_token - b.start_token == 16 for a, b in zip(rows, rows[1:]))
