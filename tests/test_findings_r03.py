"""Findings of round 3."""

import os

import pytest

import __spark_entry__ as E
from conftest import SF


@pytest.fixture(scope="module")
def folder_tables(spark, tmp_path_factory):
    """Tables whose documents are a folder of several files."""
    at = str(tmp_path_factory.mktemp("folder-tables"))
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(f"{at}/documents.parquet")
    return at


def test_stream_dedupe_reads_a_table_of_several_files(spark, folder_tables):
    query = E.queries()["stream_dedupe"]
    rows = {tuple(r) for r in query(spark, folder_tables).collect()}
    assert rows and rows == {tuple(r) for r in query(spark, SF).collect()}


def test_blank_files_of_one_size_share_their_bytes(spark, tmp_path):
    from docprep.sources.readers import read_files
    from docprep.sources.sinks import write_blank_files

    size = (1 << 20) + 5
    rows = [(f"b={i % 2}/{i}.txt", size if i < 6 else 3) for i in range(8)]
    folder = str(tmp_path / "blanks")
    df = spark.createDataFrame(rows, "path string, length long").repartition(1)
    for _ in range(2):  # a second run replaces the files
        assert write_blank_files(df, folder) == len(rows)
        found = {r["path"].split("/blanks/")[1]: bytes(r["content"]) for r in read_files(spark, folder).collect()}
        assert found == {path: b" " * n for path, n in rows}
    # one file on the disk for each size
    assert len({os.stat(f"{folder}/{path}").st_ino for path, _ in rows}) == 2


def test_stream_prepare_spreads_an_epoch_of_one_file(spark, tmp_path):
    from docprep.streaming.stream import prepare_stream, read_stream

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    files = spark.range(40).selectExpr("id AS batch_id", "0 AS ord", "'a.txt' AS filename", "5L AS length", "concat('text ', id) AS text")
    files.coalesce(1).write.parquet(src)
    prepare_stream(read_stream(spark, src, files.schema), out, str(tmp_path / "ck")).awaitTermination()
    parts = [f for f in os.listdir(f"{out}/epoch=0") if f.endswith(".parquet")]
    assert len(parts) == spark.sparkContext.defaultParallelism
    assert spark.read.parquet(out).count() == 40


def _odd_words(spark):
    """Letters whose case, width or class is out of the ordinary, between gaps of one and of more characters."""
    texts = ["ΟΔΟΣ ΣΑΣ.σας ςΣσ", "İSTANBUL ISTANBUL istanbul i̇stanbul ıstanbul", "𝔘𝔫 𐐀𐐨 😀😀 ²½ Ⅷ ٣٤", "ǅ ǆ Ǆ ﬀ ß ẞ SS K k Å å", "a_b a­b a\r\nb ñ ñ 日本 語", "", "x", None]
    return spark.createDataFrame([(f"{i % 6}" if i else None, t) for i, t in enumerate(texts)], "id string, t string").repartition(3)


def _native_runs(df, longest):
    """Every run of up to ``longest`` words as (id, start, end, matched, key), by Spark's own regex, split and lower."""
    from docprep.functions.models import TOKEN_RX
    from docprep.functions.pii import Recognizer, find_spans
    from pyspark.sql import functions as F

    spans = find_spans(F.col("t"), Recognizer("location", TOKEN_RX, 0.85, name="token"))
    lower = F.transform(F.regexp_extract_all("t", F.lit(TOKEN_RX), 0), F.lower)
    found = []
    for r in df.select("id", "t", spans.alias("s"), lower.alias("l")).collect():
        for i in range(len(r.s)):
            for j in range(i, min(i + longest, len(r.s))):
                if all(r.s[k].end + 1 == r.s[k + 1].start for k in range(i, j)):
                    found.append((r.id, r.s[i].start, r.s[j].end, r.t[r.s[i].start : r.s[j].end], " ".join(r.l[i : j + 1])))
    return found


@pytest.mark.parametrize("longest", [2, 8])
def test_gazetteer_finds_runs_as_arrays(spark, longest):
    from docprep.functions import models as M

    df = _odd_words(spark)
    runs = _native_runs(df, longest)
    # every second key, written as it is found and in capitals
    keys = sorted({r[4] for r in runs})[::2]
    terms = [(r[3],) for r in runs if r[4] in keys]
    gaz = spark.createDataFrame(terms + [(t.upper(),) for (t,) in terms], "term string")
    known = {r.k for r in M._terms(gaz, "term").withColumnRenamed("__key", "k").collect()}
    found = M.gazetteer_spans(df, "t", gaz, id_cols=("id",))
    got = [(r.id, r.start, r.end, r.matched) for r in found.collect()]
    want = [r[:4] for r in runs if r[4] in known]
    order = lambda rows: sorted(rows, key=str)
    assert order(got) == order(want) and len(want) > len(keys)
    # words are found as arrays inside the tasks, not by an expression a word
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_word_runs_of_texts_of_any_length(spark):
    import numpy as np

    from docprep.functions import wordruns as W
    from docprep.functions.models import TOKEN_RX

    kit, every = W.WordKit(W.word_codes(spark, TOKEN_RX)), np.ones(64, bool)
    texts = ["ab cd, " * (W.CHUNK // 3), None, "", "é😀x y", "z" * (W.CHUNK + 5), "k"]
    got = []
    for words, joined, at, rows, starts in kit.chunks(texts):
        first, n = words.runs(2, 64, every)
        begin, end = words.begin[first], words.end[first + n - 1]
        piece = np.searchsorted(at, begin, "right") - 1
        shift = starts[piece] - at[piece]
        got += zip(rows[piece].tolist(), (begin + shift).tolist(), (end + shift).tolist(), (joined[i:j] for i, j in zip(begin.tolist(), end.tolist())))
    assert all(texts[row][i:j] == m for row, i, j, m in got)
    pairs = W.CHUNK // 3
    assert len(got) == len(set(got)) == 3 * pairs + 5 + 1 + 1  # ab, cd, "ab cd" each time; é, x, y and two pairs; the two others
    assert {r[3] for r in got if r[0] == 0} == {"ab", "cd", "ab cd"}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_written_archives_are_read_over_all_cores(spark, tmp_path, monkeypatch, kind):
    import hashlib

    from docprep.sources import sinks

    monkeypatch.setattr(sinks, "READ_MEMBERS", 4)  # several frames an archive and one of several archives
    texts = {(b, i): None if i == 1 else f"text {b} {i} é" * i for b in (7, 8, None) for i in range(6 if b == 7 else 3)}
    rows = [(b, i, "same.md" if i < 2 else f"{i}.md", t, "success") for (b, i), t in texts.items()]
    df = spark.createDataFrame(rows, "batch_id long, ord int, markdown_filename string, markdown_content string, status string")
    df = df.withColumn("batch_id", df.batch_id.cast(kind))
    manifest = sinks.write_bundles(df.coalesce(1), str(tmp_path))
    one_file = str(tmp_path / "one")
    manifest.coalesce(1).write.parquet(one_file)
    found = sinks.written_contents(spark.read.parquet(one_file), str(tmp_path))
    assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert dict(found.dtypes) == {"batch_id": "bigint" if kind == "long" else kind, "place": "bigint", "member": "string", "n_bytes": "bigint", "digest": "string"}
    held = lambda t: (t or "").encode()
    names = ["same.md", "same (2).md"]
    want = {(None if b is None else b if kind == "long" else str(b), i, names[i] if i < 2 else f"{i}.md", len(held(t)), hashlib.md5(held(t)).hexdigest()) for (b, i), t in texts.items()}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert sinks.written_contents(spark.read.parquet(one_file).where("false"), str(tmp_path)).count() == 0
