from datetime import datetime

from sigilite.streaming.scan import scan_stream, write

GH = "gh" + "p_" + "Zq8vKd3LxWm5RtYp7NcB2HfJ9sGuTe4QaVwX"
SCHEMA = "unit_seq bigint, path string, text string, seen_at timestamp"


def test_stream(spark, tmp_path):
    rows = [(1, "a.py", f"x {GH}", datetime(2024, 1, 1)), (2, "a.py", f"x {GH}", datetime(2024, 1, 1, 1)), (3, "b.py", "cpf 529.982.247-25", datetime(2024, 1, 2)), (4, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    write(scan_stream(stream), str(tmp_path / "all"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "all")).count() == 3
    write(scan_stream(stream, event_time="seen_at"), str(tmp_path / "once"), str(tmp_path / "c2")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "once")).collect()
    assert sorted(r.rule_id for r in got) == ["cpf", "github-token"] and {r.commit for r in got} == {None}
