"""Findings of round 4."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF
from docprep.operators import extract as X
from docprep.plans.prepare import prepare
from docprep.sources import readers
from docprep.streaming.stream import scratch


@pytest.fixture
def small_frames(monkeypatch):
    for name, value in (("LISTED_ROWS", 3), ("FRAME_BYTES", 20), ("TASK_BYTES", 10)):
        monkeypatch.setattr(readers, name, value)


def _rows(df, *columns):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.select(*columns).collect()), key=str)


def test_the_driver_holds_no_list_of_the_files(spark):
    out = E.queries()["prepare_files"](spark, SF)
    assert "files-list" in "".join(out.inputFiles())
    # as many as the listing's files, whatever the number of documents
    assert len(out.inputFiles()) <= 1 + 1 + spark.sparkContext.defaultParallelism
    assert not [f for f in out.inputFiles() if "/files-in-" in f]
    assert "binaryFile" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_listing_has_the_rows_of_the_scan(spark, tmp_path, small_frames, scheme):
    names = ["a.txt", "b c.MD", "é.md", "a%20b.html", "none", "e=1/x.txt", "e=1/f/g/deep.tar.ZIP", "_k=v/in.txt", "_k=v/_z=1.txt", "_hidden/in.txt", "_h.txt", ".h.txt", "z.txt._COPYING_"]
    names += [f"many/{i}.txt" for i in range(25)]
    for i, name in enumerate(names):
        at = tmp_path / "in" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"\xff" * (i + 1))
        os.utime(at, ns=(10**18, 10**18 + i * 1_234_567_891))
    (tmp_path / "in" / "empty.txt").touch()
    (tmp_path / "in" / "no-files").mkdir()
    os.symlink(tmp_path / "in" / "nowhere", tmp_path / "in" / "dangling.txt")
    os.symlink(tmp_path / "in" / "e=1", tmp_path / "in" / "linked")
    folder = f"{scheme}{tmp_path}/in"
    columns = ("path", "filename", "length", "modificationTime", "ext", "content")
    for glob in (None, "*.{txt,md}", "[a-b]*", "?.md"):
        scan = readers.read_files(spark, folder, glob)
        listed = readers.read_files(spark, folder, glob, listing=scratch(spark, "t-list"))
        assert listed.dtypes == scan.select(*listed.columns).dtypes and set(listed.columns) == set(columns)
        assert _rows(listed, *columns) == _rows(scan, *columns) != []
        bare = readers.read_files(spark, folder, glob, with_content=False, listing=scratch(spark, "t-list"))
        assert "content" not in bare.columns and _rows(bare, *columns[:-1]) == _rows(scan, *columns[:-1])
    own = readers.read_files(spark, folder, recursive=False, with_content=False, listing=scratch(spark, "t-list"))
    assert {r.filename for r in own.collect()} == {"a.txt", "b c.MD", "é.md", "a%20b.html", "none"}


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    assert readers.read_files(spark, str(tmp_path), listing=scratch(spark, "t-list")).count() == 0


@pytest.mark.parametrize("codecs", [True, False])
def test_prepare_reads_the_bytes_of_listed_files(spark, tmp_path, small_frames, codecs):
    from docprep.sources.catalogs import MAX_FILE_SIZE

    def codec():
        def handler(raw):
            if raw.startswith(b"!"):
                raise ValueError("broken")
            return f" {len(raw)} bytes "

        return handler

    bodies = {"a.txt": b"hola\n\n\nmundo", "b.md": b"\xff\xfe", "c.html": b"<p>x</p>" * 9, "d.pdf": b"12345", "e.pdf": b"!", "f.docx": b"d", "g.exe": b"g"}
    for batch in (1, 2):
        (tmp_path / f"batch={batch}").mkdir()
        for name, body in bodies.items():
            (tmp_path / f"batch={batch}" / name).write_bytes(body * batch)
    for i in range(60):  # over the limit of a batch
        (tmp_path / "batch=2" / f"{i}.txt").write_bytes(b"t")
    for name in ("big.txt", "big.pdf"):
        with open(tmp_path / "batch=1" / name, "wb") as fh:
            fh.truncate(MAX_FILE_SIZE + 1)

    def prepared(files):
        files = files.withColumns({"batch_id": F.regexp_extract("path", "/batch=([0-9]+)/", 1).cast("long"), "ord": F.lit(0)})
        return prepare(files, text_col=None, content_col="content")

    before = X.registered_extractors()
    X.clear_extractors()
    if codecs:
        X.register_extractor(".pdf", codec)
    try:
        scan = prepared(readers.read_files(spark, str(tmp_path)))
        listed = prepared(readers.read_files(spark, str(tmp_path), with_content=False, listing=scratch(spark, "t-list")))
    finally:
        X.restore_extractors(before)
    assert listed.dtypes == scan.dtypes
    got = _rows(listed, *listed.columns)
    assert got == _rows(scan, *scan.columns) and len(got) == 2 * len(bodies) + 62
    codes = {(r.batch_id, r.original_filename): r.error_code for r in listed.collect()}
    assert codes[1, "big.txt"] == codes[1, "big.pdf"] == "FILE_TOO_LARGE" and codes[1, "b.md"] == "FAILED" and codes[2, "a.txt"] == "TOO_MANY_FILES"
    assert codes[1, "d.pdf"] == (None if codecs else "EXTRACTOR_UNAVAILABLE")


def test_bytes_of_files_over_the_limit_are_not_read(spark, tmp_path, small_frames):
    (tmp_path / "in").mkdir()
    for i in range(30):
        (tmp_path / "in" / f"{i}.txt").write_bytes(b"x" * i)
    listed = readers.read_files(spark, str(tmp_path / "in"), with_content=False, listing=scratch(spark, "t-list"))
    for i in range(11, 30):  # a read of one of these would fail
        (tmp_path / "in" / f"{i}.txt").unlink()
    found = {r.length: r.content for r in readers.read_content(listed, "content", 10).collect()}
    assert found == {i: bytearray(b"x" * i) if i <= 10 else None for i in range(1, 30)}
