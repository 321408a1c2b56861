"""Inputs the registered queries derive from the driver tables.

The tables are clean prose, so the queries add deterministic noise (blank
runs, comments, fences, table rows, invisible characters), Spanish IDs and
file metadata *from the rows themselves*. Each derivation is written twice,
as a Spark expression and as the equal DuckDB SQL, next to each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docprep.functions.pii import DNI_LETTERS
from docprep.functions.text import sql_str
from docprep.session import spread


# Tables whose rows carry whole texts: worth spreading over all cores.
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


# --------------------------------------------------------------------------- compaction noise

# Literal (search, replacement) pairs applied in order.
NOISE_PAIRS: list[tuple[str, str]] = [
    ("\n", " \t\n\n\n"),
    (". ", ".  \r\n<!-- n\n -->\n|  | |\n\u200b\ufeff"),
    (", ", ",\u00ad\n~~~\n\n\n"),
    ("e d", "e\u00a0 d"),
]


def noisy(text: Column) -> Column:
    for a, b in NOISE_PAIRS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def noisy_sql(expr: str) -> str:
    for a, b in NOISE_PAIRS:
        expr = f"replace({expr}, {sql_str(a)}, {sql_str(b)})"
    return expr


def noisy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", "lang", "text", noisy(F.col("text")).alias("noisy"))


NOISY_DOCUMENTS_SQL = f"SELECT doc_id, source, lang, text, {noisy_sql('text')} AS noisy FROM documents"


# --------------------------------------------------------------------------- files

# The extension given to document i is EXT_CYCLE[i % 31].
EXT_CYCLE = [
    ".txt", ".md", ".html", ".pdf", ".json", ".txt", ".exe", ".PDF", ".docx", ".png", "",
    ".csv", ".xml", ".htm", ".txt", ".tar.ZIP", ".md", ".jpg", ".", ".txt", ".mp3", ".md",
    ".TXT", ".epub", ".txt", ".xlsx", ".html", ".md", ".bin", ".txt", ".webp",
]
LANGS = ["de", "en", "es", "fr"]
SIZE_FACTOR = 3000  # bytes per UTF-8 byte of text: long documents exceed the 50 MB limit


def _lang_index(lang: Column) -> Column:
    expr = F.lit(9)
    for i, l in reversed(list(enumerate(LANGS))):
        expr = F.when(lang == l, F.lit(i)).otherwise(expr)
    return expr


def _lang_index_sql(lang: str) -> str:
    cases = " ".join(f"WHEN {lang} = '{l}' THEN {i}" for i, l in enumerate(LANGS))
    return f"(CASE {cases} ELSE 9 END)"


def file_name(doc_id: Column, source: Column, lang: Column) -> Column:
    ext = F.element_at(F.array(*[F.lit(e) for e in EXT_CYCLE]), (doc_id % len(EXT_CYCLE) + 1).cast("int"))
    prefix = (
        F.when(doc_id % 7 == 0, F.lit("../../"))
        .when(doc_id % 11 == 0, F.lit("C:\\tmp\\"))
        .when(doc_id % 13 == 0, F.lit("x\t"))
        .otherwise(F.lit(""))
    )
    return F.concat(prefix, source, F.lit("/"), lang, F.lit("_"), doc_id.cast("string"), ext)


def file_name_sql(doc_id: str, source: str, lang: str) -> str:
    exts = "[" + ", ".join(sql_str(e) for e in EXT_CYCLE) + "]"
    prefix = (
        f"(CASE WHEN {doc_id} % 7 = 0 THEN '../../' WHEN {doc_id} % 11 = 0 THEN {sql_str('C:' + chr(92) + 'tmp' + chr(92))} "
        f"WHEN {doc_id} % 13 = 0 THEN {sql_str('x' + chr(9))} ELSE '' END)"
    )
    return f"({prefix} || {source} || '/' || {lang} || '_' || CAST({doc_id} AS VARCHAR) || {exts}[{doc_id} % {len(EXT_CYCLE)} + 1])"


def files(spark: SparkSession, sf_dir: str, id_text: bool = False) -> DataFrame:
    """One file per document: batch_id, ord, filename, length, text."""
    return files_from_documents(table(spark, sf_dir, "documents"), id_text)


def files_from_documents(d: DataFrame, id_text: bool = False) -> DataFrame:
    """The file view of a documents frame (batch or streaming).

    With ``id_text`` the text carries the injected Spanish IDs (the size still
    comes from the original text, so admission is the same)."""
    if id_text:
        d = d.withColumn("text_src", F.col("text")).withColumn("text", with_ids(F.col("text"), F.col("doc_id")))
    else:
        d = d.withColumn("text_src", F.col("text"))
    return d.select(
        "doc_id",
        "source",
        "lang",
        ((F.col("doc_id") / 80).cast("long") * 10 + _lang_index(F.col("lang"))).cast("long").alias("batch_id"),
        (F.col("doc_id") % 80).cast("int").alias("ord"),
        file_name(F.col("doc_id"), F.col("source"), F.col("lang")).alias("filename"),
        (F.octet_length("text_src") * SIZE_FACTOR).cast("long").alias("length"),
        "text",
    )


# --------------------------------------------------------------------------- Spanish IDs

CIF_LETTERS = "ABCDEFGHJKLMNPQRSUVW"


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def id_parts(doc_id: Column) -> dict[str, Column]:
    """IDs built from the row: valid for even doc ids, check digits shifted for odd ones."""
    n = (doc_id * 7919) % 100000000
    odd = doc_id % 2
    letters = F.lit(DNI_LETTERS)
    dni = F.concat(_pad(n, 8), letters.substr(((n % 23 + odd) % 23 + 1).cast("int"), F.lit(1)))
    n7 = n % 10000000
    nie = F.concat(F.lit("X"), _pad(n7, 7), letters.substr(((n7 % 23 + odd) % 23 + 1).cast("int"), F.lit(1)))
    head = F.lit(2800000000).cast("long") + n
    nss_check = _pad((head % 97 + odd) % 97, 2)
    nss = F.when(doc_id % 3 == 0, F.concat(F.lit("28/"), _pad(n, 8), F.lit("/"), nss_check)).otherwise(
        F.concat(F.lit("28"), _pad(n, 8), nss_check)
    )
    cif = F.concat(F.lit(CIF_LETTERS).substr((doc_id % 20 + 1).cast("int"), F.lit(1)), _pad(n7, 7), (doc_id % 10).cast("string"))
    bban = F.concat(_pad(n, 8), _pad(doc_id % 1000000000000, 12))
    iban_check = (98 - F.concat(bban, F.lit("142800")).cast("decimal(38,0)") % 97).cast("long")
    iban_cc = _pad((iban_check + odd) % 100, 2)
    iban = F.concat(F.lit("ES"), iban_cc, F.lit(" "), bban.substr(1, 4), F.lit(" "), bban.substr(5, 4), F.lit("  "), bban.substr(9, 12))
    day = (doc_id % 28 + 1).cast("string")
    plate = F.concat(_pad(doc_id % 10000, 4), F.lit(" BCD"))
    card = F.concat(F.lit("4"), _pad(n, 8), _pad(doc_id % 10000000, 7))
    return {
        "dni": dni,
        "nie": nie,
        "nss": nss,
        "cif": cif,
        "iban": iban,
        "plate": plate,
        "date_long": F.concat(day, F.lit(" de enero de 2024")),
        "date_iso": F.concat(F.lit("2024-01-"), F.lpad(day, 2, "0")),
        "date_num": F.concat(day, F.lit("/01/2024")),
        "card": card,
    }


def id_parts_sql(doc_id: str) -> dict[str, str]:
    n = f"(({doc_id} * 7919) % 100000000)"
    odd = f"({doc_id} % 2)"
    L = sql_str(DNI_LETTERS)

    def pad(x: str, k: int) -> str:
        return f"lpad(CAST({x} AS VARCHAR), {k}, '0')"

    n7 = f"({n} % 10000000)"
    head = f"(2800000000 + {n})"
    nss_check = pad(f"(({head} % 97 + {odd}) % 97)", 2)
    bban = f"({pad(n, 8)} || {pad(f'({doc_id} % 1000000000000)', 12)})"
    iban_check = f"CAST(98 - CAST({bban} || '142800' AS HUGEINT) % 97 AS BIGINT)"
    iban_cc = pad(f"(({iban_check} + {odd}) % 100)", 2)
    day = f"CAST({doc_id} % 28 + 1 AS VARCHAR)"
    return {
        "dni": f"({pad(n, 8)} || substr({L}, CAST(({n} % 23 + {odd}) % 23 + 1 AS INTEGER), 1))",
        "nie": f"('X' || {pad(n7, 7)} || substr({L}, CAST(({n7} % 23 + {odd}) % 23 + 1 AS INTEGER), 1))",
        "nss": f"(CASE WHEN {doc_id} % 3 = 0 THEN '28/' || {pad(n, 8)} || '/' || {nss_check} ELSE '28' || {pad(n, 8)} || {nss_check} END)",
        "cif": f"(substr('{CIF_LETTERS}', CAST({doc_id} % 20 + 1 AS INTEGER), 1) || {pad(n7, 7)} || CAST({doc_id} % 10 AS VARCHAR))",
        "iban": f"('ES' || {iban_cc} || ' ' || substr({bban}, 1, 4) || ' ' || substr({bban}, 5, 4) || '  ' || substr({bban}, 9, 12))",
        "plate": f"({pad(f'({doc_id} % 10000)', 4)} || ' BCD')",
        "date_long": f"({day} || ' de enero de 2024')",
        "date_iso": f"('2024-01-' || lpad({day}, 2, '0'))",
        "date_num": f"({day} || '/01/2024')",
        "card": f"('4' || {pad(n, 8)} || {pad(f'({doc_id} % 10000000)', 7)})",
    }


# How the IDs are written into the text: (label before, part name).
ID_LAYOUT = [
    (" DNI ", "dni"),
    (", NIE ", "nie"),
    (". NSS ", "nss"),
    (" CIF ", "cif"),
    (" cuenta ", "iban"),
    (" coche ", "plate"),
    (" el ", "date_long"),
    (" y ", "date_iso"),
    (" o ", "date_num"),
    (" tarjeta ", "card"),
]
NAME_WORD_RX = "[A-Za-z]+"


def with_ids(text: Column, doc_id: Column) -> Column:
    parts = id_parts(doc_id)
    pieces: list[Column] = [text]
    for label, key in ID_LAYOUT:
        pieces += [F.lit(label), parts[key]]
    word = F.upper(F.regexp_extract(text, NAME_WORD_RX, 0))
    pieces += [F.lit("\nNombre: "), word, F.lit("\nfin")]
    return F.concat(*pieces)


def with_ids_sql(text: str, doc_id: str) -> str:
    parts = id_parts_sql(doc_id)
    pieces = [text]
    for label, key in ID_LAYOUT:
        pieces += [sql_str(label), parts[key]]
    pieces += [sql_str("\nNombre: "), f"upper(regexp_extract({text}, '{NAME_WORD_RX}', 0))", sql_str("\nfin")]
    return "(" + " || ".join(pieces) + ")"


def id_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", "lang", with_ids(F.col("text"), F.col("doc_id")).alias("text"))


ID_DOCUMENTS_SQL = f"SELECT doc_id, source, lang, {with_ids_sql('text', 'doc_id')} AS text FROM documents"


def files_sql(id_text: bool = False) -> str:
    text = with_ids_sql("text", "doc_id") if id_text else "text"
    return f"""SELECT doc_id, source, lang,
  CAST((doc_id // 80) * 10 + {_lang_index_sql('lang')} AS BIGINT) AS batch_id,
  CAST(doc_id % 80 AS INTEGER) AS ord,
  {file_name_sql('doc_id', 'source', 'lang')} AS filename,
  CAST(strlen(text) * {SIZE_FACTOR} AS BIGINT) AS length,
  {text} AS text
FROM documents"""


FILES_SQL = files_sql(False)
FILES_ID_SQL = files_sql(True)
