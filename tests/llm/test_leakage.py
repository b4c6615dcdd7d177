import random

import pytest

from sigilite.llm import leakage
from sigilite.llm.leakage import leaks, remove_leaks, spans_by_item, winnow, words


def brute(items, tokens, least):
    """item -> (longest common run of words, words of the text in common runs of at least ``least``)."""
    out = {}
    for item, text in items.items():
        run = [[0] * (len(text) + 1) for _ in range(len(tokens) + 1)]
        best, covered = 0, set()
        for a in range(len(tokens)):
            for b in range(len(text)):
                if tokens[a] == text[b]:
                    n = run[a + 1][b + 1] = run[a][b] + 1
                    best = max(best, n)
                    if n >= least:
                        covered |= set(range(a + 1 - n, a + 1))
        if best >= least:
            out[item] = (best, len(covered))
    return out


def test_automaton_equals_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        alphabet = "abcdefg"[: rng.randint(2, 7)]
        items = {i: [rng.choice(alphabet) for _ in range(rng.randint(1, 14))] for i in range(5)}
        items[9] = items[1][-6:] + items[2][:5]
        tokens = [rng.choice(alphabet + "z") for _ in range(40)] + items[1] + items[9]
        a = leakage.SuffixAutomaton(items, 4)
        got = {i: (n, sum(hi - lo for lo, hi in s)) for i, (n, s) in spans_by_item(a, tokens).items()}
        assert got == brute(items, tokens, 4)


def test_winnowing_keeps_every_passage():
    rng = random.Random(2)
    for _ in range(200):
        shared = [str(rng.random()) for _ in range(15)]
        a, b = ([str(rng.random()) for _ in range(rng.randint(0, 30))] + shared + [str(rng.random()) for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert set(winnow(a, 15)) & set(winnow(b, 15))
    assert len(winnow(["a"] * 14, 15)) == 0


ITEM = " ".join(f"palavra{i}" for i in range(40))
TAIL = " ".join(f"outra{i}" for i in range(10)) + " " + " ".join(f"palavra{i}" for i in range(20, 36))


@pytest.fixture(scope="module")
def tables(spark):
    docs = [
        (1, "antes " + ITEM.upper().replace("PALAVRA3 ", "**Palavrá3**, ") + " depois", "x"), (2, "nada aqui", "x"), (3, None, "x"), (4, "", None), (2, "nada aqui", "x"),
        (5, " ".join(ITEM.split()[:14]) + " fim", "x"), (6, "a b c " * 60 + " ".join(ITEM.split()[20:36]) + " d e f" * 60, "x"), (None, ITEM, "x"),
    ]
    items = [(10, ITEM), (11, TAIL), (12, None), (None, ITEM), (13, "")]
    return spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string")


WANT = {(1, 10): (40, 40), (1, 11): (16, 16), (6, 10): (16, 16), (6, 11): (16, 16), (None, 10): (40, 40), (None, 11): (16, 16)}


@pytest.mark.parametrize("item_words", [400_000, 0])
def test_both_ways(tables, item_words):
    got = {(r.doc_id, r.item_id): (r.longest, r.covered) for r in leaks(*tables, item_words=item_words).collect()}
    assert got == WANT


@pytest.mark.parametrize("item_words", [400_000, 0])
def test_removal(tables, item_words):
    rows = remove_leaks(*tables, item_words=item_words).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 8 and got[1].dropped and got[1].text is None and got[2].text == "nada aqui" and got[3].text is None and not got[3].dropped
    assert got[6].removed_words == 16 and "palavra" not in got[6].text and got[6].text.startswith("a b c") and got[6].item_id == "x"


def test_empty(tables):
    docs, items = tables
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0
    assert words("Ação-Óbvia_2") == ["acao", "obvia", "2"]
