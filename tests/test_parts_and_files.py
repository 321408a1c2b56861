"""Tables in parts (X5), envelopes and archives as files (S8, S9), first by ord and percent in streams (ST2, ST3)."""

import json
import os
import zipfile

from pyspark.sql import functions as F

from docprep.operators.admission import with_places
from docprep.operators.tables import table_parts, table_to_markdown
from docprep.plans.prepare import prepare
from docprep.sources.sinks import batch_envelope, envelope_lines, write_bundles, write_envelopes, written_contents
from docprep.streaming.stream import first_stream, latest_rows, progress_stream, read_stream, scratch, write_append, write_updates


def test_parts_join_to_the_whole_table(spark):
    # a hot table, a small one, a null one; ties of the order and equal rows
    rows = [("hot", i // 3, f"a|{i % 2}\nb") for i in range(2500)] + [("s", 1, None), (None, 2, "x"), (None, 2, "x")]
    df = spark.createDataFrame(rows, "t string, o long, v string").repartition(5)
    parts = table_parts(df, ["t"], ["o"], ["o", "v"], part_rows=100).collect()
    whole = {r.t: r.markdown for r in table_to_markdown(df, ["t"], ["o"], ["o", "v"]).collect()}
    got = {}
    for r in sorted(parts, key=lambda r: r.part):
        got[r.t] = f"{got[r.t]}\n{r.markdown}" if r.t in got else r.markdown
    assert got == whole
    assert {(r.t, r.part): r.n_rows for r in parts} == {("hot", k): 100 for k in range(25)} | {("s", 0): 1, (None, 0): 2}
    assert table_parts(df.where("false"), ["t"], ["o"], ["o", "v"]).count() == 0


def test_places_do_not_follow_the_layout(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3 == 0).alias("g"), (F.col("id") % 2).alias("h"))
    one = with_places(df.coalesce(1), ["g", "h"], ["id"], "n").collect()
    many = with_places(df.repartition(7, "h"), ["g", "h"], ["id"], "n").collect()
    assert sorted(one) == sorted(many)
    for key in {(r.g, r.h) for r in one}:
        assert [r.n for r in sorted(one) if (r.g, r.h) == key] == list(range(sum((r.g, r.h) == key for r in one)))


def _prepared(spark):
    names = ["a.txt", "b.exe", "a.txt", 'q"\\.md']
    rows = [(b, i, n, 5, f"text {i} é\n\n\n\nEnd \"x\"") for b in ("one", "a/b", None) for i, n in enumerate(names)]
    rows += [("errors", 0, "x.exe", 5, "t"), ("good", 0, "x.md", 5, ""), ("many", 0, "x.md", 5, "y")]
    rows += [("many", i, "x.md", 5, "y") for i in range(1, 120)]
    df = spark.createDataFrame(rows, "batch_id string, ord int, filename string, length long, text string").repartition(6)
    return prepare(df)


def _read(spark, manifest, folder):
    root = folder.removeprefix("file:")
    return {r.batch_id: open(os.path.join(root, r.path), "rb").read() for r in manifest.collect()}


def test_envelope_files_are_the_envelopes(spark):
    out, folder = _prepared(spark), scratch(spark, "t-env")
    want = {r.batch_id: r.json for r in batch_envelope(out).collect() if r.batch_id is not None}
    got = {b: raw.decode() for b, raw in _read(spark, write_envelopes(out, folder), folder).items()}
    null = json.loads(got.pop(None))
    assert got == want and len(null["results"]) == 3 and null["total_files"] == 4
    assert json.loads(got["many"]).keys() == {"detail"} and json.loads(got["errors"])["results"] == []
    assert not [n for n in os.listdir(folder.removeprefix("file:")) if n.endswith(".part")]
    lines = envelope_lines(out).where("batch_id = 'many'").collect()
    assert [(r.section, r.position) for r in lines] == [("detail", 0)]
    assert envelope_lines(out.where("false")).count() == 0


def test_archives_as_streams(spark):
    out, folder = _prepared(spark), scratch(spark, "t-zip")
    manifest = write_bundles(out, folder)
    held = {r.batch_id: r for r in manifest.collect()}
    assert set(held) == {"one", "a/b", None, "good"} and held["one"].n_rows == 3  # none for rejected batches and for errors alone
    texts = {r.ord: r.markdown_content for r in out.where("batch_id = 'one' and status = 'success'").collect()}
    with zipfile.ZipFile(os.path.join(folder.removeprefix("file:"), held["one"].path)) as zf:
        assert zf.testzip() is None
        assert [zf.read(i).decode() for i in zf.infolist()] == [texts[k] for k in sorted(texts)]
        assert len(set(zf.namelist())) == 3
    rows = written_contents(manifest, folder).collect()
    assert len(rows) == 10 and [r.n_bytes for r in rows if r.batch_id == "good"] == [0]
    first = _read(spark, manifest, folder)
    assert _read(spark, write_bundles(out, folder), folder) == first  # a second run replaces the files with the same bytes


def test_first_by_ord_whatever_the_arrival(spark):
    schema = "k string, ord int, v string, at timestamp"
    source, out, ck = (scratch(spark, f"t-first-{x}") for x in ("in", "out", "ck"))
    t = 1_700_000_000
    waves = [
        [("a", 9, "a9", t), ("b", 5, "b5", t), ("n", None, "none", t), ("only", None, "null", t)],
        [("a", 3, "a3", t + 60), ("a", 3, "a3", t + 60), ("b", 7, "b7", t - 600)],
        [("a", 4, "a4", t + 30), ("n", 8, "n8", t + 5), (None, 1, "key", t)],
        [("z", 0, "z", t + 90_000)],  # moves the watermark; its own session stays open
    ]
    for wave in waves:
        rows = spark.createDataFrame(wave, "k string, ord int, v string, s long").select("k", "ord", "v", F.timestamp_seconds("s").alias("at"))
        rows.write.mode("append").parquet(source)
        write_append(first_stream(read_stream(spark, source, schema), ["k"], "at"), out, ck).awaitTermination()
    got = {r.k: (r.ord, r.v) for r in spark.read.parquet(out).collect()}
    assert got == {"a": (3, "a3"), "b": (5, "b5"), "n": (8, "n8"), "only": (None, "null"), None: (1, "key")}


def test_percent_of_announced(spark):
    schema = "batch_id string, status string"
    source, out, ck = (scratch(spark, f"t-pct-{x}") for x in ("in", "out", "ck"))
    announced = spark.createDataFrame([("a", 3), ("b", 200), ("zero", 0)], "batch_id string, announced int")
    waves = [[("a", "success"), ("b", "error"), ("late", "success")], [("a", "error"), ("zero", "success")]]
    for wave in waves:
        spark.createDataFrame(wave, schema).write.mode("append").parquet(source)
        write_updates(progress_stream(read_stream(spark, source, schema), announced=announced), out, ck).awaitTermination()
    rows = spark.read.parquet(out)
    assert {(r.epoch, r.batch_id, r.percent) for r in rows.collect()} == {(0, "a", 33), (0, "b", 1), (0, "late", None), (1, "a", 67), (1, "zero", None)}
    last = {r.batch_id: (r.total_files, r.successful, r.failed, r.announced) for r in latest_rows(rows, ["batch_id"]).collect()}
    assert last == {"a": (2, 1, 1, 3), "b": (1, 0, 1, 200), "late": (1, 1, 0, None), "zero": (1, 1, 0, 0)}
