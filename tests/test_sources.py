"""Text files as rows, in batch and as a stream."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from plumbspark.operators import Rewrite, append_if_absent, classify, manifest_items, rewrite_lines
from plumbspark.sources import number_lines, read_documents, read_lines, small_table
from plumbspark.sources.storage import checkpoint_dir

TEXTS = {"empty.txt": b"", "open.txt": b"a\r\nb", "closed.txt": b"a\n\nb\n", "long.txt": b"".join(b"line %d\n" % i for i in range(20_000))}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("texts")
    for name, data in TEXTS.items():
        (folder / name).write_bytes(data)
    return str(folder)


@pytest.fixture
def many_blocks(spark):
    for key, value in (("spark.sql.files.maxPartitionBytes", "4k"), ("spark.sql.files.openCostInBytes", "1")):
        spark.conf.set(key, value)
    yield
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


def expected_lines():
    for name, data in TEXTS.items():
        lines = data.decode().split("\n")
        for i, line in enumerate(lines[:-1] if lines[-1] == "" else lines, 1):
            yield name, i, line


def test_numbered_lines(spark, folder, many_blocks):
    lines = read_lines(spark, folder)
    assert lines.rdd.getNumPartitions() > 10
    got = number_lines(lines).select(F.element_at(F.split("source", "/"), -1), "line_no", "text").collect()
    assert sorted(map(tuple, got)) == sorted(expected_lines())
    some = number_lines(lines, F.col("text").rlike("^(line 7777|b)$")).collect()
    assert sorted((r.line_no, r.text) for r in some) == [(2, "b"), (3, "b"), (7778, "line 7777")]
    items = manifest_items(number_lines(lines), token="all").where("item = '19999'").collect()
    assert [r.line_no for r in items] == [20_000]


def test_lines_are_not_moved(spark, folder):
    plan = read_lines(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_documents(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: r.text for r in read_documents(spark, folder).collect()}
    assert got == {name: data.decode() for name, data in TEXTS.items() if data or name in got}


def test_a_stream_of_edits(spark, folder, tmp_path):
    read_documents(spark, folder).write.parquet(str(tmp_path / "documents"))
    stream = spark.readStream.schema("path string, text string").parquet(str(tmp_path / "documents"))
    edited = append_if_absent(rewrite_lines(stream, [Rewrite("^a", "A")]), "# m", "# m\n")
    labelled = classify(edited, [("numbered", "startswith(text, 'line')")], default="plain")
    query = labelled.writeStream.format("memory").queryName("edits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.label, r.text[:3], r.changed) for r in spark.table("edits").collect() if r.text != "# m\n"}
    assert got == {("plain", "A\r\n", True), ("plain", "A\n\n", True), ("numbered", "lin", True)}


def test_small_tables_have_a_size(spark):
    table = small_table(spark, [("a", 1, None), ("b", None, True)], "x string, y long, z boolean")
    assert "LocalRelation" in table._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in table.collect()] == [("a", 1, None), ("b", None, True)]
    assert small_table(spark, [], "x string").count() == 0


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder=None):
        context = SimpleNamespace(getConf=lambda: {"spark.checkpoint.dir": folder} if folder else {}, getCheckpointDir=lambda: folder, master=master)
        return SimpleNamespace(sparkContext=context)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(session("spark://host:7077"))
    assert checkpoint_dir(session("spark://host:7077", "/shared")) == "/shared"


def test_a_cut_leaves_no_shuffle_files(spark):
    import time
    from glob import glob

    from plumbspark.sources.storage import CLEANUP, cut

    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    files = lambda: {x.rsplit("/", 1)[-1] for x in glob(f"{folder}/*/shuffle_*")}
    counted = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
    before = files()
    done = cut(counted)
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, counted.collect()))
    assert spark.conf.get(CLEANUP) == "false"
