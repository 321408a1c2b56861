"""Names (N1-N9), admission (P1-P10), batch operators (A1-A3, W1, W4, U1), N6."""

from conftest import SF, one
from pyspark.sql import functions as F

from docprep.functions import names as N
from docprep.functions import tokens as T
from docprep.operators import admission as A
from docprep.operators.names import unique_names


def test_safe_filename(spark):
    got = one(spark, N.safe_filename, "../../etc/passwd.md", "..\\..\\windows\\system32\\evil.md", "evil\x00\n<img src=x>.txt", "", None, "a" * 300)
    assert got[:3] == ["passwd.md", "evil.md", "evil<img src=x>.txt"]
    assert got[3:5] == ["file", "file"]
    assert got[5] == "a" * 255


def test_extensions(spark):
    assert one(spark, N.extension, "a.tar.ZIP", ".pdf", "x.", "hello.txt", "dir.d/name", "..pdf") == [".zip", "", "", ".txt", "", ".pdf"]
    assert one(spark, N.extension_lenient, ".pdf", "x.", "none", "A.PDF") == [".pdf", ".", "", ".pdf"]


def test_markdown_names(spark):
    assert one(spark, N.markdown_filename, "hello.txt", "captura.png", None, "a/b.c.d") == ["hello.md", "captura.md", "file.md", "b.c.md"]
    assert one(spark, N.ensure_md, "sin_extension", "X.MD", "doc.md") == ["sin_extension.md", "X.MD", "doc.md"]


def test_escape_and_formats(spark):
    assert one(spark, N.escape_html, "<a href=\"x\">'&'</a>", None) == ["&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;", ""]
    assert one(spark, N.format_size, 0, 512, 1536, 1048576, 52428801, schema="v long") == ["0 Bytes", "512 Bytes", "1.5 KB", "1 MB", "50 MB"]
    assert one(spark, N.format_elapsed, 850.4, 1250.0, schema="v double") == ["850 ms", "1.3 s"]


def test_token_formats(spark):
    assert one(spark, T.abbreviate_tokens, 999, 12345, 1200000, 999950, schema="v long") == ["999", "12,3k", "1,2M", "1000,0k"]
    assert one(spark, T.abbreviate_window, 128000, 1000000, 1500000, schema="v long") == ["128k", "1M", "1,5M"]
    assert one(spark, T.format_count_es, 1250, 12345, 1234567, schema="v long") == ["1250", "12.345", "1.234.567"]
    assert one(spark, lambda c: T.estimate_tokens(c, 3.6), "", None, "a" * 36, "a\U0001F600") == [0, 0, 10, 1]


def test_unique_names(spark):
    df = spark.createDataFrame(
        [(1, i, n) for i, n in enumerate(["doc", "doc", "doc (2)", "doc", "doc.md", "doc.md", "doc.md", "doc."])],
        "batch_id long, ord int, name string",
    )
    got = [r.unique_name for r in unique_names(df).orderBy("ord").collect()]
    assert got == ["doc", "doc (2)", "doc (2) (2)", "doc (3)", "doc.md", "doc (2).md", "doc (3).md", "doc."]


def _files(spark):
    rows = [
        (1, 0, "a.txt", 5, "alpha"),
        (1, 1, "b.exe", 2, "\x00\x00"),
        (1, 2, "big.txt", 50 * 1024 * 1024 + 1, "x"),
        (2, 0, "ok.md", 3, "hey"),
    ] + [(3, i, f"f{i}.txt", 1, "x") for i in range(51)]
    return spark.createDataFrame(rows, "batch_id long, ord int, filename string, length long, text string")


def test_admission_codes(spark):
    adm = A.admit(A.with_format(A.with_names(_files(spark))))
    codes = {(r.batch_id, r.ord): r.error_code for r in adm.collect()}
    assert codes[(1, 0)] is None and codes[(2, 0)] is None
    assert codes[(1, 1)] == "UNSUPPORTED_FORMAT"
    assert codes[(1, 2)] == "FILE_TOO_LARGE"
    assert all(codes[(3, i)] == "TOO_MANY_FILES" for i in range(51))


def test_admission_broadcast_and_shuffle_paths_agree(spark):
    named = A.with_format(A.with_names(_files(spark)))
    small = A.admit(named)  # rejected set broadcast
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan  # the files are not shuffled by batch
    big = A.admit(named, max_broadcast_batches=0)  # bound exceeded: shuffle join
    cols = ["batch_id", "ord", "error_code", "error", "http_status"]
    assert sorted(small.select(cols).collect()) == sorted(big.select(cols).collect())


def test_pipeline_summary_and_order(spark):
    from docprep.plans.prepare import prepare

    out = prepare(_files(spark))
    summary = {r.batch_id: (r.total_files, r.successful, r.failed) for r in A.batch_summary(out).collect()}
    assert summary[1] == (3, 1, 2) and summary[2] == (1, 1, 0) and summary[3] == (51, 0, 51)
    pos = {(r.batch_id, r.ord): r.position for r in A.order_results(out).collect()}
    assert pos[(1, 0)] == 0 and pos[(1, 1)] == 1 and pos[(1, 2)] == 2 and pos[(3, 0)] is None
    res = {r.ord: r for r in out.filter("batch_id = 1").collect()}
    assert res[0].markdown_content == "alpha" and res[0].markdown_filename == "a.md" and res[0].original_chars == 5


def test_dedupe_keeps_first(spark):
    df = spark.createDataFrame([(1, 2, "a", 1, "second"), (1, 1, "a", 1, "first"), (1, 3, "a", 2, "other")], "batch_id long, ord int, filename string, length long, text string")
    got = sorted((r.ord, r.text) for r in A.dedupe_files(df).collect())
    assert got == [(1, "first"), (3, "other")]


def test_assign_batches_bounded(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source")
    b = A.assign_batches(d, 7, bucket="source")
    sizes = b.groupBy("batch_id").count().agg(F.max("count")).first()[0]
    assert sizes <= 7 and b.count() == d.count()
    plain = A.assign_batches(d, 7)
    assert plain.groupBy("batch_id").count().agg(F.max("count")).first()[0] <= 7
    # one bucket per batch, and no exchange: partitions are only sorted locally
    assert b.groupBy("batch_id").agg(F.countDistinct("source").alias("k")).agg(F.max("k")).first()[0] == 1
    assert "Exchange" not in b._jdf.queryExecution().executedPlan().toString()


def test_html_structure(spark):
    from docprep.functions.html import html_to_markdown

    cases = {
        "<head><title>t</title></head><header>top</header><link rel='x'>a": "top\n\na",
        "<table><tr><th>Name</th><th>Age</th></tr><tr class=\"r\"><td>Ana</td><td>3</td></tr></table>": "| Name | Age |\n| Ana | 3 |",
        "<ul><li>uno</li><li id=\"b\">dos</li></ul>": "* uno\n* dos",
        "<img src=\"p.png\" alt=\"foto\"> <img alt=\"otra\" width=3 src=\"q.png\"/>": "![foto](p.png) ![otra](q.png)",
        "<a class='x' href='u/1'>uno</a> <article href=\"n\">dos</article>": "[uno](u/1)\n\ndos",
        "a&ntilde;o caf&eacute; &iquest;l&apos;&Uuml;? &laquo;x&raquo; 5&euro; &amp;eacute;": "año café ¿l'Ü? «x» 5€ &eacute;",
    }
    cases |= {
        "<ol><li>uno</li><li>dos</li></ol>fin": "1. uno\n2. dos\n\nfin",
        "x<pre>\na  b\n   &lt;c>  \n\n\nd\n</pre>  y": "x\n\n```\na  b\n   <c>  \n\n\nd\n```\n\ny",
        "<a href=\"1\">open <a href=\"2\">shut</a> z": "open [shut](2) z",
        "<h2>cab<p>txt": "## cab\n\ntxt",
        "a < b <script>x</script>c <script>no end": "a < b c no end",
    }
    got = one(spark, html_to_markdown, *cases)
    assert got == list(cases.values())


def test_html_takes_linear_time(spark):
    import time

    from docprep.functions.html import html_to_markdown

    def seconds(text):
        df = spark.createDataFrame([(text,)], "v string").select(html_to_markdown(F.col("v")).alias("o"))
        start = time.time()
        df.write.format("noop").mode("overwrite").save()
        return time.time() - start

    n = 200_000
    plain = "<p>palabra</p>" * (n // 14)
    seconds(plain)
    for piece in ("<a href=\"x\">", "<h1>", "<", "<script>", "<pre>", "<ol><li>", "<img ", "<!--", "&", "</a>", "<a "):
        assert seconds(piece * (n // len(piece))) < 10 * seconds(plain) + 5, piece
    assert seconds("a" + " " * n + "b") < 10 * seconds(plain) + 5


def test_support_flags(spark):
    from docprep.operators import admission as A

    rows = [(1, "a.PDF"), (2, "b.zzz"), (3, None), (4, ""), (1, "a.PDF")]
    df = A.with_names(spark.createDataFrame(rows, "doc_id long, filename string"))
    flags = sorted((r.doc_id, r.supported) for r in A.with_support(df).collect())
    assert flags == [(1, True), (1, True), (2, False), (3, False), (4, False)]


def test_ordered_batches_whatever_the_layout(spark):
    from docprep.operators import admission as A

    rows = [(i, "hot" if i % 3 else (None if i % 2 else f"s{i % 5}"), "old") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, ord string")
    want, seen = {}, {}
    for i, source, _ in rows:
        n = seen[source] = seen.get(source, -1) + 1
        want[i] = (f"{source or ''}:{n // 50}", n % 50)
    for layout in (df, df.repartition(7), df.orderBy(F.desc("doc_id")).coalesce(2)):
        got = A.assign_ordered_batches(layout, "source", ["doc_id"], 50)
        assert {r.doc_id: (r.batch_id, r.ord) for r in got.collect()} == want
    assert A.assign_ordered_batches(df.where("false"), "source", ["doc_id"]).collect() == []


def test_csv_tables(spark):
    from docprep.functions.csv import csv_to_markdown

    cases = {
        "a,b\n1,2\n": "| a | b |\n| --- | --- |\n| 1 | 2 |",
        'n,"x, y"\r\n"he said ""hi""","two\nlines"\r\n': '| n | x, y |\n| --- | --- |\n| he said "hi" | two lines |',
        "a,b,c\n1\n\n2,3,4,5": "| a | b | c |  |\n| --- | --- | --- | --- |\n| 1 |  |  |  |\n| 2 | 3 | 4 | 5 |",
        'p|q,""\n"""",""': '| p\\|q |  |\n| --- | --- |\n| " |  |',
        'open,"rest, of\nall': "| open | rest, of all |\n| --- | --- |",
        "": "",
        "\n\n": "",
        None: None,
    }
    assert one(spark, csv_to_markdown, *cases) == list(cases.values())
