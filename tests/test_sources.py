import pytest
from pyspark.sql import functions as F

from stratalog.engine import Engine
from stratalog.plans.errors import ProgramError


def run(spark, folder, text):
    return Engine(spark, str(folder)).load(text).run().lines


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,day,at,num,txt,flag,mix\n1,2026-01-02,2026-01-02T03:04:05,1.5,"a, ""b""",true,1\n2,2026-01-03,,2,"",false,x\n 3 ,,,,,,\n')
    assert run(spark, tmp_path, 'import "t.csv" as t. ?- t(A, B, C, D, E, F, G).') == [
        't(1, @2026-01-02, @2026-01-02T03:04:05, 1.5, "a, \\"b\\"", true, "1").', 't(2, @2026-01-03, absent, 2.0, "", false, "x").', "t(3, absent, absent, absent, absent, absent, absent).",
    ]
    (tmp_path / "u.csv").write_text("1,x\n2,y\n")
    assert run(spark, tmp_path, 'import "u.csv" as u(k: int, v: symbol). ?- u(K, V).') == ["u(1, x).", "u(2, y)."]


def test_csv_errors(spark, tmp_path):
    (tmp_path / "u.csv").write_text("k,v\n1,x\n2,y\n")
    for text, code in (('import "u.csv" as u(k: int).', "source-schema-mismatch"), ('import "u.csv" as u(k: int, v: int). ?- u(K, V).', "unconvertible-cell"), ('import "u.csv" table "t" as u.', "unsupported-format")):
        with pytest.raises(ProgramError) as e:
            run(spark, tmp_path, text)
        assert e.value.codes == [code]


def test_jsonl(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"a": 1, "b": "x", "c": 1.5}\n{"a": 2, "b": null}\n')
    assert run(spark, tmp_path, 'import "t.jsonl" as t. ?- t(a: A, b: B, c: C).') == ['t(1, "x", 1.5).', "t(2, absent, absent)."]
    assert run(spark, tmp_path, 'import "t.jsonl" as t(c: float, b: string, a: int). ?- t(A, B, C).') == ["t(absent, absent, 2).", 't(1.5, "x", 1).']
    (tmp_path / "n.ndjson").write_text('{"a": [1]}\n')
    with pytest.raises(ProgramError) as e:
        run(spark, tmp_path, 'import "n.ndjson" as t.')
    assert e.value.codes == ["unsupported-column"]


def test_parquet_and_unions(spark, tmp_path):
    spark.range(3).select(F.col("id").cast("int").alias("k"), F.lit("2026-01-01").cast("date").alias("d"), F.col("id").cast("decimal(5,1)").alias("x")).write.parquet(str(tmp_path / "p.parquet"))
    (tmp_path / "q.csv").write_text("k,d,x\n9,2026-01-02,0.5\n")
    text = 'import "p.parquet" as p. import "q.csv" as p. p(0, @2026-01-01, 0.0). ?- p(K, D, X).'
    assert run(spark, tmp_path, text) == ["p(0, @2026-01-01, 0.0).", "p(1, @2026-01-01, 1.0).", "p(2, @2026-01-01, 2.0).", "p(9, @2026-01-02, 0.5)."]


def test_unneeded_imports_are_not_read(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("k\nnot a number\n")
    assert run(spark, tmp_path, 'import "bad.csv" as b(k: int). p(1). ?- p(X).') == ["p(1)."]


def test_integers_beyond_64_bits_and_values_that_are_no_numbers(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"a": pa.array([1, 2**63 - 1], pa.uint64())}), tmp_path / "u.parquet")
    assert run(spark, tmp_path, 'import "u.parquet" as u. ?- u(A).') == ["u(1).", f"u({2**63 - 1})."]
    pq.write_table(pa.table({"a": pa.array([1, 2**64 - 1], pa.uint64())}), tmp_path / "v.parquet")
    pq.write_table(pa.table({"a": [1.5, float("nan")]}), tmp_path / "w.parquet")
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n{"a": 100000000000000000000}\n')
    (tmp_path / "r.csv").write_text("a,b\n1,2\n3\n4,5,6\n")
    for file in ("v.parquet", "w.parquet", "j.jsonl", "r.csv"):
        with pytest.raises(ProgramError) as e:
            run(spark, tmp_path, f'import "{file}" as t. ?- t(a: A).')
        assert e.value.codes == ["unreadable-source"], file
