"""Models (U3), gazetteer (D12), extractors (X3/U4), bundles (S8), streaming (ST1-ST3)."""

import io
import re
import zipfile

from conftest import SF
from pyspark.sql import functions as F

from docprep.functions import models as M
from docprep.operators import extract as X
from docprep.plans.prepare import prepare
from docprep.sources.sinks import batch_envelope, export_bundles


def _capitalised_factory():
    rx = re.compile(r"\b[A-Z][a-z]{3,}\b")  # stands in for a statistical model

    def predict(text):
        return [(m.start(), m.end(), 0.8) for m in rx.finditer(text)]

    return predict


def test_register_model_spans(spark):
    M.register_model("person", _capitalised_factory)
    df = spark.createDataFrame([(1, "hola Maria y Pedro"), (2, None)], "doc_id long, text string")
    rows = M.detect_with_model(df, "text", "person", "PERSON").orderBy("start").collect()
    assert [(r.start, r.end, r.matched) for r in rows] == [(5, 10, "Maria"), (13, 18, "Pedro")]
    # code-point offsets across astral characters and chunk boundaries of a long text
    long_text = "😀 " * 700 + "Lucia " + "ñ" * 1500 + " Sergio"
    df2 = spark.createDataFrame([(3, long_text)], "doc_id long, text string")
    got = [(r.start, r.end, r.matched) for r in M.detect_with_model(df2, "text", "person", "PERSON").orderBy("start").collect()]
    want = [(m.start(), m.end(), m.group()) for m in re.finditer(r"\b[A-Z][a-z]{3,}\b", long_text)]
    assert got == want and [g[2] for g in got] == ["Lucia", "Sergio"]


def test_gazetteer(spark):
    df = spark.createDataFrame([(1, "Vivo en Sevilla, cerca de sevilla la vieja")], "doc_id long, text string")
    gaz = spark.createDataFrame([("Sevilla",), ("Madrid",)], "term string")
    rows = M.gazetteer_spans(df, "text", gaz).orderBy("start").collect()
    assert [(r.start, r.end, r.matched) for r in rows] == [(8, 15, "Sevilla"), (26, 33, "sevilla")]
    # over the byte bound the gazetteer is not broadcast: same spans through a shuffle join
    shuffled = M.gazetteer_spans(df, "text", gaz, max_broadcast_bytes=0)
    assert [(r.start, r.end, r.matched) for r in shuffled.orderBy("start").collect()] == [(8, 15, "Sevilla"), (26, 33, "sevilla")]


def _files(spark):
    rows = [
        (1, 0, "a.txt", 5, b"alpha"),
        (1, 1, "c.png", 4, b"fake"),
        (1, 2, "d.pdf", 4, b"%PDF"),
        (1, 3, "e.pdf", 4, b"%PDF"),
    ]
    return spark.createDataFrame(rows, "batch_id long, ord int, filename string, length long, content binary")


def test_extractors_fallback_and_errors(spark):
    def ocr_missing():
        raise OSError("engine not installed")

    def pdf_primary():
        def run(b):
            if b == b"%PDF":
                return "   \n  "  # blank: falls back
            raise RuntimeError("broken")

        return run

    def general():
        return lambda b: "MD from fallback"

    X.clear_extractors()
    try:
        X.register_extractor("ocr", ocr_missing)
        X.register_extractor("pdf", pdf_primary, fallback=general)
        out = {r.ord: r for r in prepare(_files(spark), text_col=None, content_col="content").collect()}
    finally:
        X.clear_extractors()
    assert out[0].markdown_content == "alpha" and out[0].status == "success"
    assert out[1].status == "error" and out[1].error_code == "EXTRACTOR_UNAVAILABLE"
    assert out[2].markdown_content == "MD from fallback"


def test_route_and_fallback(spark):
    df = spark.createDataFrame([(".JPG", None), (".pdf", "  "), (".txt", "x")], "ext string, p string")
    got = df.select(X.route(F.col("ext")).alias("r"), X.with_fallback(F.col("p"), F.lit("fb")).alias("t")).collect()
    assert [(r.r, r.t) for r in got] == [("ocr", "fb"), ("pdf", "fb"), ("general", "x")]


def test_bundles_and_envelope(spark):
    rows = [(1, i, "doc.md", 3, "# x") for i in range(3)] + [(1, 3, "bad.exe", 1, "z")]
    df = spark.createDataFrame(rows, "batch_id long, ord int, filename string, length long, text string")
    out = prepare(df)
    b = export_bundles(out).collect()[0]
    with zipfile.ZipFile(io.BytesIO(b.archive)) as zf:
        assert sorted(zf.namelist()) == ["doc (2).md", "doc (3).md", "doc.md"]
        assert zf.read("doc.md").decode() == "# x"
    env = batch_envelope(out).collect()[0]
    assert (env.total_files, env.successful, env.failed) == (4, 3, 1)
    assert '"total_files":4' in env.json
    assert env.batch_error is None and len(env.results) == 3 and len(env.errors) == 1


def test_envelope_of_rejected_batch_has_no_lists(spark):
    # batch 2 has 51 files: rejected whole, like the request-level error
    rows = [(1, 0, "a.txt", 1, "a")] + [(2, i, f"f{i}.txt", 1, "x") for i in range(51)]
    df = spark.createDataFrame(rows, "batch_id long, ord int, filename string, length long, text string")
    env = {r.batch_id: r for r in batch_envelope(prepare(df)).collect()}
    assert env[1].batch_error is None and len(env[1].results) == 1
    rej = env[2]
    assert (rej.total_files, rej.successful, rej.failed) == (51, 0, 51)
    assert rej.results is None and rej.errors is None
    assert rej.batch_error == "Too many files (max 50)"
    assert rej.json == '{"detail":"Too many files (max 50)"}'


def test_streaming_equals_batch(spark):
    import __spark_entry__ as E

    stream = {tuple(r) for r in E.queries()["stream_prepare"](spark, SF).collect()}
    batch = {tuple(r) for r in E.queries()["prepare"](spark, SF).collect()}
    assert stream == batch


def test_progress_updates_over_several_epochs(spark):
    from docprep.operators.admission import batch_summary
    from docprep.streaming.stream import latest_rows, progress_stream, read_stream, scratch, write_updates

    rows = [(b, s) for b in (1, 2) for s in ("success", "error", "success")] + [(3, "error")]
    df = spark.createDataFrame(rows, "batch_id long, status string")
    src = scratch(spark, "t-progress-src")
    for i in range(3):  # three files: one per trigger
        df.filter(F.col("batch_id") % 3 == i).coalesce(1).write.mode("append").parquet(src)
        df.coalesce(1).write.mode("append").parquet(src)
    stream = read_stream(spark, src, df.schema, max_files=1)
    out, ck = scratch(spark, "t-progress-out"), scratch(spark, "t-progress-ck")
    write_updates(progress_stream(stream), out, ck).awaitTermination()
    written = spark.read.parquet(out)
    assert written.select("epoch").distinct().count() > 1
    got = {tuple(r) for r in latest_rows(written, ["batch_id"]).select("batch_id", "total_files", "successful", "failed").collect()}
    want = {tuple(r) for r in batch_summary(spark.read.parquet(src)).select("batch_id", "total_files", "successful", "failed").collect()}
    assert got == want


def test_binary_files_oversized_bytes_not_read(spark, tmp_path):
    from docprep.sources.catalogs import MAX_FILE_SIZE
    from docprep.sources.readers import read_files

    (tmp_path / "a.txt").write_bytes(b"hola\n\n\nmundo")
    (tmp_path / "b.md").write_bytes(b"# t\n")
    with open(tmp_path / "big.txt", "wb") as fh:
        fh.truncate(MAX_FILE_SIZE + 1)  # sparse file just over the limit
    files = read_files(spark, str(tmp_path)).withColumns({"batch_id": F.lit(1).cast("long"), "ord": F.lit(0)})
    out = prepare(files, text_col=None, content_col="content")
    got = {r.original_filename: (r.status, r.error_code, r.markdown_content) for r in out.collect()}
    assert got["a.txt"] == ("success", None, "hola\n\nmundo")
    assert got["b.md"] == ("success", None, "# t")
    assert got["big.txt"][:2] == ("error", "FILE_TOO_LARGE")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,52428800)" in plan  # the size filter reaches the scan that reads bytes
    scans = [line for line in plan.split("\n") if "ReadSchema" in line]
    with_bytes = [line for line in scans if "content:binary" in line]
    # every scan that reads bytes (native and codec branches) carries the size filter
    assert with_bytes and all("LessThanOrEqual(length,52428800)" in line for line in with_bytes)
    assert any("content:binary" not in line and "GreaterThan(length,52428800)" in line for line in scans)


def test_every_file_gets_one_row_whatever_its_bytes(spark, tmp_path):
    from pyspark.sql import functions as F

    from docprep.operators.extract import clear_extractors, register_extractor
    from docprep.plans.prepare import NOT_UTF8, prepare

    def factory():
        def handler(raw):
            return None if raw.startswith(b"\xff\xd8") else f"{len(raw)} bytes"

        return handler

    def broken():
        raise ValueError("no engine")

    rows = [(1, 1, "good.txt", b"hola"), (1, 2, "lat.txt", b"a\xf1o 2024"), (1, 3, "a.pdf", b"%PDF-1.4\xe2\xe3\xcf"), (1, 4, "b.png", b"\xff\xd8\xff"), (1, 5, "c.docx", b"PK\x03")]
    files = spark.createDataFrame([(*r[:3], len(r[3]), bytearray(r[3])) for r in rows], "batch_id long, ord int, filename string, length long, content binary")
    try:
        register_extractor("pdf", factory)
        register_extractor("ocr", factory)
        register_extractor("general", broken)
        out = prepare(files, text_col=None, content_col="content")
        got = {r.original_filename: r for r in out.select("original_filename", "status", "error", "markdown_content").collect()}
    finally:
        clear_extractors()
    assert len(got) == 5
    assert got["good.txt"].markdown_content == "hola" and got["a.pdf"].markdown_content == "11 bytes"
    assert (got["lat.txt"].status, got["lat.txt"].error) == ("error", NOT_UTF8)
    assert (got["b.png"].status, got["b.png"].error) == ("error", "the handler returned no text")
    assert (got["c.docx"].status, got["c.docx"].error) == ("error", "no engine")


def test_gazetteer_terms_of_several_words(spark):
    df = spark.createDataFrame([(1, "De Nueva  York a nueva york, a Nueva-York y York"), (2, None), (3, "")], "doc_id long, text string")
    gaz = spark.createDataFrame([("Nueva York",), ("york",), ("...",), (None,)], "term string")
    want = {(10, 14, "York"), (17, 27, "nueva york"), (23, 27, "york"), (31, 41, "Nueva-York"), (37, 41, "York"), (44, 48, "York")}
    for bound in (M.MAX_BROADCAST_TERM_BYTES, 0):
        assert {(r.start, r.end, r.matched) for r in M.gazetteer_spans(df, "text", gaz, max_broadcast_bytes=bound).collect()} == want
    predict = M.gazetteer_model(gaz)()
    assert [s[:2] for s in predict(df.first().text)] == [(10, 14), (17, 27), (31, 41), (44, 48)]
    assert M.gazetteer_spans(df, "text", gaz.where("false")).count() == 0


def test_runs_grow_only_as_prefixes_of_terms(spark, monkeypatch):
    text = "a b c d e f g h, B C x a b c d e f g h i"
    terms = ["a b c d e f g h", "b c", "c d e", "e f g h i j", "h", "H"]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    at = [(m.start(), m.end()) for m in re.finditer(r"\w+", text)]
    want = set()
    for i in range(len(at)):
        for j in range(i, len(at)):
            close = all(at[k][1] + 1 == at[k + 1][0] for k in range(i, j))
            if close and " ".join(text[a:b].lower() for a, b in at[i : j + 1]) in {t.lower() for t in terms}:
                want.add((at[i][0], at[j][1], text[at[i][0] : at[j][1]]))
    gaz = spark.createDataFrame([(t,) for t in terms], "term string")
    found = lambda g: [(r.start, r.end, r.matched) for r in M.gazetteer_spans(df, "text", g).collect()]
    assert sorted(found(gaz)) == sorted(want) and len(want) == 9
    # a filter with every bit set lets all runs through to the join: the same rows
    monkeypatch.setattr(M, "_prefix_filter", lambda terms, n: [-1] * 16)
    assert sorted(found(gaz)) == sorted(want)
    monkeypatch.undo()
    assert [text[a:b] for a, b, _ in M.gazetteer_model(gaz)()(text)] == ["a b c d e f g h", "B C", "a b c d e f g h"]
    # the plan does not grow with the lengths of the terms
    size = lambda g: M.gazetteer_spans(df, "text", g)._jdf.queryExecution().analyzed().toString().count("lambdafunction")
    assert size(gaz) == size(gaz.where("term = 'h'"))


def test_types_without_a_source_are_errors(spark):
    files = spark.createDataFrame([(1, 0, "a.txt", 9, "Maria vive en Nueva York, 1/2/2024"), (1, 1, "b.zzz", 9, "x")], "batch_id long, ord int, filename string, length long, text string")
    got = {r.original_filename: r for r in prepare(files, anonymize=True, entities="location,date").collect()}
    assert got["a.txt"].error_code == "ANONYMIZER_UNAVAILABLE" and got["a.txt"].http_status == 503
    assert got["a.txt"].error.endswith("location") and got["a.txt"].markdown_content is None and got["a.txt"].anonymized is None
    assert got["b.zzz"].error_code == "UNSUPPORTED_FORMAT"
    places = M.gazetteer_model(spark.createDataFrame([("nueva york",)], "term string"))
    row = prepare(files, anonymize=True, entities="location,date", models={"location": places}).filter("ord = 0").first()
    assert (row.status, row.markdown_content, row.anonymized) == ("success", "Maria vive en [DIRECCION], [FECHA]", True)


def test_stream_judges_batches_over_all_epochs(spark):
    from docprep.plans.prepare import RESULT_COLUMNS
    from docprep.streaming.stream import prepare_stream, read_prepared, read_stream, scratch

    rows = [(1, i, f"f{i}.txt", 5, f"text {i}") for i in range(60)] + [(2, i, f"g{i}.txt", 5, "ok") for i in range(4)]
    files = spark.createDataFrame(rows, "batch_id long, ord int, filename string, length long, text string")
    src, out = scratch(spark, "t-st-src"), scratch(spark, "t-st-out")
    for i in range(2):  # 30 files of batch 1 and two of batch 2 a trigger
        files.filter(F.col("ord") % 2 == i).coalesce(1).write.mode("append").parquet(src)
    prepare_stream(read_stream(spark, src, files.schema, max_files=1), out, scratch(spark, "t-st-ck")).awaitTermination()
    assert spark.read.parquet(out).select("epoch").distinct().count() == 2
    got = {tuple(r) for r in read_prepared(spark, out).select(*RESULT_COLUMNS).collect()}
    assert got == {tuple(r) for r in prepare(files).collect()}
    assert sum(r[RESULT_COLUMNS.index("error_code")] == "TOO_MANY_FILES" for r in got) == 60


def test_bundles_of_too_many_files_are_refused(spark):
    rows = [("a:0:x", i, f"f{i}.md", "# t", "success") for i in range(50)] + [("b", i, "f.md", "x", "success") for i in range(51)] + [("c", 0, "f.md", "x", "error")]
    df = spark.createDataFrame(rows, "batch_id string, ord int, markdown_filename string, markdown_content string, status string")
    got = {r.batch_id: r for r in export_bundles(df).collect()}
    assert set(got) == {"a:0:x", "b"} and got["a:0:x"].n_files == 50 and got["a:0:x"].error is None
    assert got["b"].archive is None and got["b"].error == "Too many files (max 50)"
