import importlib
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from veilspark.operators import attest, evaluate
from veilspark.sources import readers
from veilspark.sources.sinks import export_chain, write_report, write_results
from veilspark.streaming import streams

KEY = bytes(32)


def test_windows_over_a_stream(spark, small, tmp_path):
    src = str(tmp_path / "in")
    t = spark.read.parquet(f"{small}/scrub_requests.parquet").select("transaction_id", "payload", F.col("ingested_at").cast("timestamp").alias("at"))
    t.write.parquet(src)
    stream = spark.readStream.schema(t.schema).parquet(src)
    q = streams.flag_windows(stream, "at", "transaction_id", "payload").writeStream.outputMode("complete").format("memory").queryName("flags").start()
    q.processAllAvailable()
    q.stop()
    batch = streams.flag_windows(t, "at", "transaction_id", "payload")
    assert sorted(map(tuple, spark.table("flags").collect())) == sorted(map(tuple, batch.collect()))


def test_chain_over_a_stream(spark, tmp_path):
    rows = [("c", f"t{i}", f"2025-01-01T00:00:{i:02d}+00:00", [], [], i, i, None, i) for i in range(6)]
    schema = "chain_id string, transaction_id string, issued_at string, detected array<string>, redacted array<string>, char_in int, char_out int, downstream_target string, seq int"
    src = str(tmp_path / "in")
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = streams.receipt_stream(stream, KEY).writeStream.outputMode("append").format("memory").queryName("chain").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.createDataFrame(spark.table("chain").collect(), attest.RECEIPT)  # a memory table can't be joined to itself
    assert attest.verify(got, KEY).first().valid and got.count() == 6
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, attest.issue(spark.createDataFrame(rows, schema), KEY, ["seq"]).collect()))


def test_readers_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a b",), ("c",)], "payload string")
    for kind in ("parquet", "orc", "json"):
        df.write.format(kind).save(str(tmp_path / kind))
        assert sorted(r.text for r in readers.requests(spark, str(tmp_path / kind), kind, schema="payload string").collect()) == ["a b", "c"]
    df.write.text(str(tmp_path / "text"))
    df.write.option("header", True).csv(str(tmp_path / "csv"))
    assert readers.requests(spark, str(tmp_path / "text"), "text").count() == 2
    assert readers.requests(spark, str(tmp_path / "csv"), "csv", schema="payload string").count() == 2
    assert readers.health(spark).first().status == "ok"
    export_chain(spark.createDataFrame([("c", 1, "b"), ("c", 0, "a")], "chain_id string, chain_position int, receipt_hash string"), str(tmp_path / "chain"))
    assert spark.read.json(str(tmp_path / "chain")).count() == 2
    write_report("# x\n", str(tmp_path / "r.md"))
    write_results(df, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text().startswith("[")


def test_entry(spark, small):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {"p2_found", "p3_found", "p5_found"} <= set(queries)


def test_core_stands_without_the_text_subpackage():
    code = "import sys; sys.modules['veilspark.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p3_found' in q and 'p6_ids' not in q; assert not any(m.startswith('veilspark.llm.') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=importlib.import_module("os").path.dirname(importlib.import_module("__spark_entry__").__file__))


def test_small_results_are_whole_or_an_error(spark, tmp_path):
    rows = spark.range(1001).select(F.format_string("%05d", "id").alias("tool"), F.lit("|").alias("line"))
    path = tmp_path / "r.json"
    with pytest.raises(ValueError, match="more than 1000"):
        write_results(rows, str(path))
    with pytest.raises(ValueError, match="more than 1000"):
        evaluate.report(rows)
    assert not path.exists()
    write_results(rows.limit(1000), str(path))
    assert path.read_text().count("tool") == 1000 and evaluate.report(rows.limit(1000)).splitlines().count("|") == 1000


def test_hook_failures_are_reported(spark):
    seen = []
    write = streams.webhook_writer("http://x", report=lambda n, counts: seen.append((n, counts)), send=lambda u, b, h, t: 500)
    write(spark.createDataFrame([("r1",), ("r2",)], "receipt_id string"), 7)
    assert seen == [(7, {False: 2})]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch, tmp_path):
    from veilspark import session

    class Context:
        def __init__(self, master, folder=None):
            self.master, self.folder = master, folder

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, master, named=None):
            self.sparkContext = Context(master)
            self.conf = type("C", (), {"get": lambda _, k, d=None: named})()

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="share"):
            session.checkpoint_dir(Session(master))
        assert session.checkpoint_dir(Session(master, "hdfs://x/y")) == "hdfs://x/y"
    assert session.checkpoint_dir(Session("local[4]")).startswith("file://")
    df = session.cut(spark.range(3))
    import os

    path = df._veilspark_path.removeprefix("file:")
    assert df.count() == 3 and os.path.isdir(path)
    session.discard(df)
    assert not os.path.isdir(path)


def test_the_report_has_its_sections(spark):
    tools = evaluate.other_tools(spark)
    own = spark.createDataFrame([("own", 1.0, 1.0, 1.0, "local", True, True, False)], evaluate.TOOL)
    text = evaluate.report(evaluate.report_rows(own, tools), evaluate.capability_rows(own.unionByName(tools)), [r.tool for r in own.unionByName(tools).select("tool").collect()])
    assert [x for x in text.splitlines() if x.startswith("## ")] == ["## Method", "## Detected", "## Comparison", "## Capabilities"]
    assert "| No data leaves | ❌ | ❌ | ❌ | ✅ | ✅ |" in text


def test_without_a_library_of_its_own_the_core_stands(tmp_path):
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p3_found' in q and 'p6_ids' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=importlib.import_module("os").path.dirname(importlib.import_module("__spark_entry__").__file__))
