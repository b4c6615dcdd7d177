from pyspark.sql import functions as F

from sigilite.llm.history import BEFORE, History, position, repeats

ROWS = [  # fingerprint, rule, path, redacted, batch, id, whether it is a case
    ("F0", "r", "a/b.py", "ab…yz", 0, 0, None),  # accepted before
    ("f0", "r", "a/b.py", "abcd…wxyz", 1, 1, True),  # same fingerprint in another case
    ("f1", "r", "a/c.py", "kkkk…llll", 1, 2, False),
    ("f1", "r", "a/c.py", "kkkk…llll", 2, 3, True),  # again
    ("f2", "r", "A\\C.py", "kkkk…llll", 2, 4, True),  # spelt otherwise
    ("f3", "r", "z/c.py", "kkkk…llll", 2, 5, True),  # moved
    ("f4", "r", "a/c_old.py", "kkkk…llll", 2, 6, True),  # renamed
    ("f5", "s", "a/c.py", "kkkk…llll", 2, 7, True),  # another rule, same path
    ("f6", "r", "q/other.py", "kkkk…llll", 2, 8, False),  # unrelated file
    ("f7", "t", "q/c.py", "kkkk…llll", 2, 9, False),  # another rule and folder
    ("f8", "r", "a/c.py", "kk…ll", 3, 10, True),  # ends in another length
    ("f9", "r", "a/c.py", "k…", 3, 11, False),  # first character only
    ("fa", "r", "./a/c.py", "k…", 3, 12, True),  # ... agrees with the like
    ("fb", "r", "a/b.py", "abXX…XXyz", 3, 13, True),  # agrees with what the baseline shows
]


def _rows(spark, rows):
    df = spark.createDataFrame([r[:6] for r in rows], "fingerprint string, rule string, path string, redacted string, batch int, i bigint")
    pos = F.when(F.col("batch") == 0, F.lit(BEFORE).cast("long")).otherwise(position(F.col("batch"), F.col("i")))
    return df.withColumn("pos", pos).withColumn("batch", F.when(F.col("batch") == 0, BEFORE).otherwise(F.col("batch"))).drop("i")


def _ids(df):
    return sorted(r.pos & ((1 << 44) - 1) for r in df.collect())


def test_cases(spark):
    assert _ids(repeats(_rows(spark, ROWS))) == [r[5] for r in ROWS if r[6]]


def test_coverage(spark):
    got = {r.pos & ((1 << 44) - 1): r.coverage for r in repeats(_rows(spark, ROWS)).collect()}
    assert got[1] == 1.0 and 0 < got[5] < 1


def test_history_batch_by_batch(spark, tmp_path):
    history = History(spark, str(tmp_path / "history"))
    history.accept(_rows(spark, [r for r in ROWS if r[4] == 0]))
    found = []
    for b in (1, 2, 3):
        batch = _rows(spark, [r for r in ROWS if r[4] == b])
        found += _ids(history.check(batch))
        history.accept(batch)
    assert sorted(found) == [r[5] for r in ROWS if r[6]]
    assert [level for level, _ in history.segments()] == [2]  # four batches, merged twice


def test_nulls_and_copies(spark):
    rows = [
        (None, None, None, None, 1, 1), (None, None, None, None, 1, 2),  # nothing to compare
        (None, "r", None, "abcd…wxyz", 1, 3), (None, "r", None, "abcd…wxyz", 2, 4),  # near without fingerprints
        ("ff", "r", "x" * 5000, "v" * 300, 1, 5), ("FF", None, "", "", 2, 6), ("gg", "r", "x" * 5000, "v" * 300, 2, 7),
    ]
    assert _ids(repeats(_rows(spark, rows))) == [4, 6, 7]
    assert repeats(_rows(spark, rows).limit(0)).count() == 0
