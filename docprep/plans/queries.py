"""Registered queries: each is a Spark plan over the driver tables plus the
equal DuckDB SQL used as its oracle (``None`` where only row counts are checked).

Every query reads whole tables (or what Spark derives from them); none caps,
samples or filters rows to stay cheap.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docprep.functions import names as N
from docprep.functions import pii as P
from docprep.functions import tokens as T
from docprep.functions.compact import compact_markdown
from docprep.functions.html import html_to_markdown
from docprep.functions.text import utf16_length
from docprep.operators import admission as A
from docprep.operators import reports as R
from docprep.plans import derived as D
from docprep.plans import sqlparts as S
from docprep.sources.catalogs import FORMATS, PLATFORMS, default_entity_keys


@dataclass
class Query:
    name: str
    spark: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str  # SURVEY ids


REGISTRY: dict[str, Query] = {}


def register(name: str, covers: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, covers)
        return fn

    return deco


PLATFORMS_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{k}', CAST({c} AS DOUBLE), CAST({w} AS BIGINT))" for i, (k, _, c, w) in enumerate(PLATFORMS)
) + ") p(platform_ordinal, platform, cpt, context_window))"

FORMATS_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{e}', '{f}')" for i, (e, f) in enumerate(FORMATS)
) + ") f(ordinal, ext, format))"


# =========================================================================== compaction, tokens


def _compacted(spark: SparkSession, sf: str) -> DataFrame:
    nd = D.noisy_documents(spark, sf)
    return nd.select(
        "doc_id",
        "source",
        "lang",
        F.length("noisy").cast("long").alias("original_chars"),
        compact_markdown(F.col("noisy")).alias("markdown"),
    )


_COMPACT_CTES, _COMPACT_OUT = S.compact_ctes("c_src", "c")
COMPACTED_SQL_PREFIX = f"""WITH nd AS ({D.NOISY_DOCUMENTS_SQL}),
c_src AS (SELECT doc_id AS id, noisy AS t FROM nd),{_COMPACT_CTES},
compacted AS (SELECT nd.doc_id, nd.source, nd.lang, CAST(length(nd.noisy) AS BIGINT) AS original_chars, o.out AS markdown
              FROM nd JOIN {_COMPACT_OUT} o ON nd.doc_id = o.id)"""


@register(
    "compact_tokens",
    "C1-C8, T1, T2, J3, A6 (flagship)",
    COMPACTED_SQL_PREFIX
    + f""",
tk AS (SELECT p.platform_ordinal, p.platform, p.context_window, {S.tokens_sql('c.markdown', 'p.cpt')} AS tokens
       FROM compacted c CROSS JOIN {PLATFORMS_SQL} p)
SELECT CAST(platform_ordinal AS INTEGER) AS platform_ordinal, platform, context_window,
       count(*) AS n_docs, CAST(sum(tokens) AS BIGINT) AS total_tokens, max(tokens) AS max_tokens,
       count_if(tokens <= context_window) AS docs_fit, count_if(tokens > context_window) AS docs_over
FROM tk GROUP BY ALL""",
)
def q_compact_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return R.token_summary(_compacted(spark, sf), "markdown")


@register(
    "compaction",
    "C1-C8, J5",
    COMPACTED_SQL_PREFIX
    + f"\nSELECT doc_id, source, lang, original_chars, {S.utf16_len_sql('markdown')} AS final_chars, markdown FROM compacted",
)
def q_compaction(spark: SparkSession, sf: str) -> DataFrame:
    return _compacted(spark, sf).withColumn("final_chars", utf16_length(F.col("markdown"))).select(
        "doc_id", "source", "lang", "original_chars", "final_chars", "markdown"
    )


_CLEAN_CTES, _CLEAN_OUT = S.compact_ctes("k_src", "k")


@register(
    "compaction_clean_text",
    "C1-C8 on untouched documents (mostly no-ops)",
    f"""WITH k_src AS (SELECT doc_id AS id, text AS t FROM documents),{_CLEAN_CTES}
SELECT d.doc_id, o.out AS markdown, o.out <> d.text AS changed FROM documents d JOIN {_CLEAN_OUT} o ON d.doc_id = o.id""",
)
def q_compaction_clean(spark: SparkSession, sf: str) -> DataFrame:
    d = D.table(spark, sf, "documents")
    done = d.select("doc_id", "text", compact_markdown(F.col("text")).alias("markdown"))
    return done.select("doc_id", "markdown", (F.col("markdown") != F.col("text")).alias("changed"))


@register(
    "per_platform",
    "J3, T1-T7",
    f"""WITH tk AS (SELECT d.doc_id, p.platform, p.context_window, {S.tokens_sql('d.text', 'p.cpt')} AS tokens
            FROM documents d CROSS JOIN {PLATFORMS_SQL} p)
SELECT doc_id, platform, tokens, tokens <= context_window AS fits,
       CAST(floor({S.fill_pct_sql('tokens', 'context_window')} * 10000) AS BIGINT) AS fill_ppm,
       {S.pct_label_sql('tokens', 'context_window')} AS pct_label,
       {S.abbreviate_tokens_sql('tokens')} AS tokens_short,
       {S.count_es_sql('tokens')} AS tokens_es,
       {S.abbreviate_window_sql('context_window')} AS window_short
FROM tk""",
)
def q_per_platform(spark: SparkSession, sf: str) -> DataFrame:
    d = D.table(spark, sf, "documents").select("doc_id", "text")
    out = R.per_platform(d, "text")
    return out.select(
        "doc_id",
        "platform",
        "tokens",
        "fits",
        F.floor(T.fill_pct(F.col("tokens"), F.col("context_window")) * 10000).cast("long").alias("fill_ppm"),
        "pct_label",
        "tokens_short",
        "tokens_es",
        "window_short",
    )


@register(
    "savings_by_source",
    "A5 over compaction",
    COMPACTED_SQL_PREFIX
    + f""",
s AS (SELECT source, lang, count(*) AS n_docs, CAST(sum(original_chars) AS BIGINT) AS original_chars,
             CAST(sum({S.utf16_len_sql('markdown')}) AS BIGINT) AS final_chars FROM compacted GROUP BY source, lang)
SELECT source, lang, n_docs, original_chars, final_chars, original_chars - final_chars AS saved_chars,
       CAST(floor((original_chars - final_chars) * 10000.0 / original_chars) AS BIGINT) AS saved_bp FROM s""",
)
def q_savings_by_source(spark: SparkSession, sf: str) -> DataFrame:
    s = R.savings_summary(_compacted(spark, sf), ("source", "lang"), "original_chars", "markdown")
    return s.select(
        "source",
        "lang",
        "n_docs",
        "original_chars",
        "final_chars",
        "saved_chars",
        F.floor(F.col("saved_chars") * 10000.0 / F.col("original_chars")).cast("long").alias("saved_bp"),
    )


def _stats_sql(orig: str, text: str) -> dict[str, str]:
    final = S.utf16_len_sql(text)
    saved = f"({orig} - {final})"
    pct = f"CAST(floor((CAST({saved} AS DOUBLE) / CAST({orig} AS DOUBLE)) * 100 + 0.5) AS BIGINT)"
    valid = f"({orig} IS NOT NULL AND {orig} <> 0 AND {orig} > {final} AND {pct} > 0)"
    return {"final": final, "saved": saved, "pct": pct, "valid": valid,
            "tokens": f"CAST(floor(CAST({saved} AS DOUBLE) / 4.0 + 0.5) AS BIGINT)"}


_ST = _stats_sql("original_chars", "markdown")


@register(
    "compression_stats",
    "T8, T10, J5",
    COMPACTED_SQL_PREFIX
    + f"""
SELECT doc_id, {_ST['final']} AS final_chars,
       CASE WHEN {_ST['valid']} THEN CAST({_ST['saved']} AS BIGINT) END AS saved_chars,
       CASE WHEN {_ST['valid']} THEN {_ST['pct']} END AS saved_pct,
       CASE WHEN {_ST['valid']} THEN {_ST['tokens']} END AS saved_tokens,
       CASE WHEN {_ST['valid']} THEN {S.sql_str(T.MINUS)} || CAST({_ST['pct']} AS VARCHAR) || '%' ELSE {S.sql_str('sin reducción')} END AS compression_label
FROM compacted""",
)
def q_compression_stats(spark: SparkSession, sf: str) -> DataFrame:
    return R.savings(_compacted(spark, sf), "original_chars", "markdown").select(
        "doc_id", "final_chars", "saved_chars", "saved_pct", "saved_tokens", "compression_label"
    )


@register(
    "text_stats",
    "T9",
    f"SELECT doc_id, {S.utf16_len_sql('text')} AS chars, {S.words_sql('text')} AS words, {S.lines_sql('text')} AS lines FROM documents",
)
def q_text_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = D.table(spark, sf, "documents")
    return d.select("doc_id", T.text_stats(F.col("text")).alias("s")).select("doc_id", "s.*")


# =========================================================================== names


@register(
    "file_names",
    "N1-N5, N7",
    f"""WITH f AS ({D.FILES_SQL})
SELECT doc_id, {S.safe_filename_sql('filename')} AS safe_name, {S.extension_sql('filename')} AS ext,
       {S.extension_lenient_sql('filename')} AS ext_lenient, {S.markdown_filename_sql('filename')} AS markdown_filename,
       {S.ensure_md_sql(S.safe_filename_sql('filename'))} AS zip_name, {S.escape_html_sql('filename')} AS escaped
FROM f""",
)
def q_file_names(spark: SparkSession, sf: str) -> DataFrame:
    f = D.files(spark, sf)
    fn = F.col("filename")
    return f.select(
        "doc_id",
        N.safe_filename(fn).alias("safe_name"),
        N.extension(fn).alias("ext"),
        N.extension_lenient(fn).alias("ext_lenient"),
        N.markdown_filename(fn).alias("markdown_filename"),
        N.ensure_md(N.safe_filename(fn)).alias("zip_name"),
        N.escape_html(fn).alias("escaped"),
    )


@register(
    "page_names",
    "N1, N2, N4 on page URLs",
    f"""SELECT page_id, {S.safe_filename_sql('url')} AS safe_name, {S.extension_sql('url')} AS ext,
       {S.markdown_filename_sql('url')} AS markdown_filename FROM pages""",
)
def q_page_names(spark: SparkSession, sf: str) -> DataFrame:
    p = D.table(spark, sf, "pages")
    u = F.col("url")
    return p.select("page_id", N.safe_filename(u).alias("safe_name"), N.extension(u).alias("ext"), N.markdown_filename(u).alias("markdown_filename"))


def _size_sql(b: str) -> str:
    pw = f"(CASE WHEN {b} < 1024 THEN 0 WHEN {b} < 1048576 THEN 1 WHEN {b} < 1073741824 THEN 2 ELSE 3 END)"
    h = f"CAST(floor((CAST({b} AS DOUBLE) / pow(1024.0, {pw})) * 100 + 0.5) AS BIGINT)"
    whole = f"CAST(CAST(trunc({h} / 100) AS BIGINT) AS VARCHAR)"
    frac = f"({h} % 100)"
    num = (
        f"(CASE WHEN {frac} = 0 THEN {whole} WHEN {frac} % 10 = 0 THEN {whole} || '.' || CAST(CAST(trunc({frac} / 10) AS BIGINT) AS VARCHAR) "
        f"ELSE {whole} || '.' || lpad(CAST({frac} AS VARCHAR), 2, '0') END)"
    )
    unit = f"(['Bytes', 'KB', 'MB', 'GB'][{pw} + 1])"
    return f"(CASE WHEN {b} = 0 THEN '0 Bytes' ELSE {num} || ' ' || {unit} END)"


def _elapsed_sql(ms: str) -> str:
    tenths = f"CAST(floor({ms} / 100 + 0.5) AS BIGINT)"
    secs = f"CAST(CAST(trunc({tenths} / 10) AS BIGINT) AS VARCHAR) || '.' || CAST({tenths} % 10 AS VARCHAR) || ' s'"
    return f"(CASE WHEN {ms} < 1000 THEN CAST(CAST(floor({ms} + 0.5) AS BIGINT) AS VARCHAR) || ' ms' ELSE {secs} END)"


@register(
    "display_formats",
    "N8, N9",
    f"""WITH f AS ({D.FILES_SQL})
SELECT f.doc_id, {_size_sql('f.length')} AS size_label, {_size_sql('d.n_chars')} AS small_label,
       {_elapsed_sql('CAST(d.n_chars AS DOUBLE) * 0.37')} AS elapsed_label
FROM f JOIN documents d ON f.doc_id = d.doc_id""",
)
def q_display_formats(spark: SparkSession, sf: str) -> DataFrame:
    d = D.table(spark, sf, "documents")
    return d.select(
        "doc_id",
        N.format_size((F.octet_length("text") * D.SIZE_FACTOR).cast("long")).alias("size_label"),
        N.format_size(F.col("n_chars")).alias("small_label"),
        N.format_elapsed(F.col("n_chars").cast("double") * 0.37).alias("elapsed_label"),
    )


# =========================================================================== admission


def _admitted(spark: SparkSession, sf: str) -> DataFrame:
    return A.admit(A.with_format(A.with_names(D.files(spark, sf))))


def _admission_sql_ctes() -> str:
    return f"""f AS ({D.FILES_SQL}),
fn AS (SELECT f.*, {S.safe_filename_sql('filename')} AS safe_name, {S.extension_sql('filename')} AS ext,
              {S.markdown_filename_sql('filename')} AS markdown_filename FROM f),
fm AS (SELECT fn.*, coalesce(c.format, 'Unknown') AS format FROM fn LEFT JOIN {FORMATS_SQL} c ON fn.ext = c.ext),
bs AS (SELECT batch_id, count(*) AS batch_files, sum(length) AS batch_bytes FROM fm GROUP BY batch_id),
adm AS (SELECT fm.*, CASE WHEN bs.batch_files > 50 THEN 'TOO_MANY_FILES'
                          WHEN coalesce(bs.batch_bytes > {A.C.MAX_BATCH_BYTES}, false) THEN 'BATCH_TOO_LARGE'
                          WHEN fm.format = 'Unknown' THEN 'UNSUPPORTED_FORMAT'
                          WHEN coalesce(fm.length > {A.C.MAX_FILE_SIZE}, false) THEN 'FILE_TOO_LARGE' END AS error_code
        FROM fm LEFT JOIN bs ON fm.batch_id = bs.batch_id)"""


def _status_sql(code: str) -> str:
    return "(CASE " + " ".join(f"WHEN {code} = '{k}' THEN {v}" for k, v in A.ERROR_STATUS.items()) + " END)"


@register(
    "admission",
    "P1-P4, P10, J1, S3",
    f"""WITH {_admission_sql_ctes()}
SELECT doc_id, batch_id, ord, ext, format, error_code, {_status_sql('error_code')} AS http_status FROM adm""",
)
def q_admission(spark: SparkSession, sf: str) -> DataFrame:
    return _admitted(spark, sf).select("doc_id", "batch_id", "ord", "ext", "format", "error_code", "http_status")


@register(
    "supported_split",
    "P1, J4 (semi / anti joins against the catalogue)",
    f"""WITH f AS ({D.FILES_SQL}), fn AS (SELECT doc_id, {S.extension_sql('filename')} AS ext,
          {S.extension_lenient_sql('filename')} AS lext FROM f)
SELECT doc_id, ext IN (SELECT ext FROM {FORMATS_SQL}) AS supported,
       lext IN (SELECT ext FROM {FORMATS_SQL}) AS client_supported FROM fn""",
)
def q_supported_split(spark: SparkSession, sf: str) -> DataFrame:
    return A.with_support(A.with_names(D.files(spark, sf))).select("doc_id", "supported", "client_supported")


@register(
    "format_mix",
    "A7, S3, S4 (families joined with per-format file counts)",
    f"""WITH {_admission_sql_ctes()},
fam AS (SELECT format, min(ordinal) AS ordinal, arg_min(ext, ordinal) AS first_ext, count(*) AS n_extensions FROM {FORMATS_SQL} GROUP BY format),
mix AS (SELECT format, count(*) AS n_files, CAST(sum(length) AS BIGINT) AS total_bytes FROM fm GROUP BY format)
SELECT fam.format, CAST(fam.ordinal AS INTEGER) AS ordinal, fam.first_ext, fam.n_extensions,
       coalesce(mix.n_files, 0) AS n_files, coalesce(mix.total_bytes, 0) AS total_bytes
FROM fam LEFT JOIN mix ON fam.format = mix.format""",
)
def q_format_mix(spark: SparkSession, sf: str) -> DataFrame:
    from docprep.sources.catalogs import format_catalog, format_families

    fam = format_families(format_catalog(spark))
    mix = R.format_mix(A.with_format(A.with_names(D.files(spark, sf))))
    # one row per catalogue label plus 'Unknown' at most: a fixed bound
    return fam.join(F.broadcast(mix), "format", "left").select(
        "format",
        "ordinal",
        "first_ext",
        "n_extensions",
        F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"),
        F.coalesce("total_bytes", F.lit(0)).cast("long").alias("total_bytes"),
    )
