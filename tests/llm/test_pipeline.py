from sigilite.llm import tokens
from sigilite.llm.pipeline import prepare_blobs, prepare_documents

OWN = "def total(rows, limit=3):\n    # adds what is open\n    return sum(r.value for r in rows if r.open)\n"
MADE = "// Code generated by maker. DO NOT EDIT.\n" + "".join(f"func (x *Row) GetA{i}() int32 {{ return x.a{i} }}\n" for i in range(20))


def test_blobs(spark):
    rows = [(i, f"src/own_{i}.py", OWN) for i in range(8)] + [(20 + i, f"app/x{i}.go", MADE) for i in range(4)]
    rows += [(40, "src/a.py", OWN + "# CÃ¡lculo, mail ana@correio.example\npassword = 'S3gur0!Ab'\n"), (41, None, None)]
    got = {r.unit_seq: r for r in prepare_blobs(spark.createDataFrame(rows, "unit_seq bigint, path string, text string")).collect()}
    assert got.keys() == {*range(8), 40, 41} and got[41].text is None
    assert got[40].text == OWN + "# Cálculo, mail <EMAIL>\npassword = 'S…'\n" and got[40].garbled_lines == 1


def test_documents(spark):
    item = " ".join(f"palavra{i}" for i in range(30))
    docs = [(1, "curto"), (2, "Uma frase curta. " * 900), (3, item), (4, "a b c d " * 40 + item + " fim"), (5, None), (6, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = prepare_documents(df, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    assert {r.doc_id for r in got} == {1, 2, 4} and all(tokens.count(r.text) <= 2048 for r in got)
    assert [r.text for r in got if r.doc_id == 4] == ["a b c d " * 40 + " fim"] and len([r for r in got if r.doc_id == 2]) > 1
