import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modalith.sources import artifacts, log_store

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def test_rows_survive_the_table(spark):
    bodies = ['{"a":1,"b":"x"}', '{"a":null}', '{"b":"q\\"]["}', "{}", '{"a":2,"b":null}']
    rows = spark.createDataFrame([(b,) for b in bodies], "body string")
    back = artifacts.table_to_rows(artifacts.rows_to_table(rows, "body", SCHEMA), SCHEMA)
    assert sorted(r.body for r in back.collect()) == sorted(bodies)


def test_foreign_tables_are_refused(spark):
    with pytest.raises(ValueError):
        artifacts.table_to_rows(spark.createDataFrame([(1, "x")], "a long, b string"), SCHEMA)


def test_compaction_empties_the_tail_or_refuses(spark, tmp_path):
    tail, lock = tmp_path / "log.jsonl", tmp_path / "log.jsonl.lock"
    tail.write_text('{"a":1}\n{"a":2}\n')
    lock.write_text("")
    with pytest.raises(RuntimeError):
        artifacts.compact_tail(spark, str(tail), str(tmp_path / "p0"), SCHEMA)
    lock.unlink()
    assert artifacts.compact_tail(spark, str(tail), str(tmp_path / "p1"), SCHEMA) == 2 and tail.read_text() == ""
    tail.write_text('{"a":1}\nhalf a li')
    with pytest.raises(ValueError):
        artifacts.compact_tail(spark, str(tail), str(tmp_path / "p2"), SCHEMA)
    assert tail.read_text().startswith('{"a":1}')


@pytest.mark.parametrize("change,message", [({"item_id": "other"}, "misaligned"), ({"run_id": "r2"}, "another run"), ({"backend": "b2"}, "another backend"), ({"embedding_index": 9}, "without"), ({"sample_index": 0}, "repeated"), ({"embedding": [1.0]}, "widths")])
def test_caches_that_do_not_fit_are_errors(spark, change, message):
    rows = [{"embedding_index": k, "item_id": "i", "sample_index": k, "run_id": "r", "backend": "b", "embedding": [1.0, float(k)]} for k in range(3)]
    samples = [{k: r[k] for k in ("embedding_index", "item_id", "sample_index", "run_id")} for r in rows]
    cache = [{k: r[k] for k in ("embedding_index", "item_id", "backend", "embedding")} for r in rows]
    make = lambda s, c: (spark.createDataFrame([tuple(x.values()) for x in s], "embedding_index long, item_id string, sample_index long, run_id string"), spark.createDataFrame([tuple(x.values()) for x in c], "embedding_index long, item_id string, backend string, embedding array<double>"))
    assert artifacts.read_embeddings(*make(samples, cache), "r", "b").count() == 3
    (name,) = change
    side = cache if name in cache[0] else samples
    side[1] |= change
    with pytest.raises(ValueError, match=message):
        artifacts.read_embeddings(*make(samples, cache), "r", "b")


def test_macros(spark):
    rows = spark.createDataFrame([("Beta", "2"), ("Alpha", "29.8\\%")], "name string, value string")
    lines = artifacts.macro_lines(rows)
    assert [r.value for r in lines.collect()] == ["\\newcommand{\\Alpha}{29.8\\%}", "\\newcommand{\\Beta}{2}"]
    assert sorted(map(tuple, artifacts.read_macros(lines).collect())) == [("Alpha", "29.8\\%"), ("Beta", "2")]
    for bad in ([("A", "1"), ("A", "2")], [("A1", "1")]):
        with pytest.raises(ValueError):
            artifacts.macro_lines(spark.createDataFrame(bad, "name string, value string"))


def test_artifacts_must_be_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("x,y\n")
    assert artifacts.read_artifact(spark, str(tmp_path / "a.csv"), ["y"]).count() == 1
    for path, needed, error in (("a.csv", ["z"], ValueError), ("b.csv", ["x"], ValueError), ("c.csv", [], FileNotFoundError)):
        with pytest.raises(error):
            artifacts.read_artifact(spark, str(tmp_path / path), needed)


def test_number_formats(spark):
    x = F.lit(0.2979)
    one = spark.range(1).select(artifacts.number_text("percent", x).alias("p"), artifacts.number_text("auroc", x).alias("a"), artifacts.number_text("count", F.lit(12345)).alias("c"), artifacts.number_text("range", x, F.lit(0.5)).alias("r"))
    assert tuple(one.first()) == ("29.8\\%", "0.298", "12,345", "29.8\\%--50.0\\%")


def test_a_tree_may_be_missing(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "full"))
    rows = log_store.read_trees(spark, [str(tmp_path / "absent"), str(tmp_path / "full")], log_store.read_parquet)
    assert {r.tree for r in rows.collect()} == {1}
