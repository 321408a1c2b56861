"""Further registered queries: PII, HTML, tables, extraction, the pipeline and
its batch operators. Importing the module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docprep.functions import pii as P
from docprep.functions.html import html_to_markdown
from docprep.operators import admission as A
from docprep.operators import extract as X
from docprep.operators import pii as OP
from docprep.operators.names import unique_names
from docprep.operators.tables import table_parts, table_to_markdown
from docprep.plans import derived as D
from docprep.plans import sqlparts as S
from docprep.plans.prepare import NOT_UTF8, prepare
from docprep.plans.queries import FORMATS_SQL, REGISTRY, _admission_sql_ctes, _status_sql, register
from docprep.sources import catalogs as C
from docprep.sources.sinks import RESULT_FIELDS, batch_envelope, envelope_lines

DEFAULT_KEYS = C.default_entity_keys()
ID_KEYS = ["dni_nie", "social_security", "company_id", "iban", "vehicle_plate", "date", "credit_card", "person"]
ALL_KEYS = DEFAULT_KEYS + ["date"]

# =========================================================================== PII


@register(
    "pii_validators",
    "R6 (DNI/NIE, NSS, CIF, IBAN, Luhn on IDs derived from every document)",
    f"""SELECT doc_id, {S.valid_sql('dni_nie', 'dni')} AS dni_ok, {S.valid_sql('dni_nie', 'nie')} AS nie_ok,
       {S.valid_sql('social_security', 'nss')} AS nss_ok, {S.valid_sql('company_id', 'cif')} AS cif_ok,
       {S.valid_sql('iban', 'iban')} AS iban_ok, {S.valid_sql('credit_card', 'card')} AS card_ok
FROM (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in D.id_parts_sql('doc_id').items())} FROM documents)""",
)
def q_pii_validators(spark: SparkSession, sf: str) -> DataFrame:
    d = D.table(spark, sf, "documents").select("doc_id")
    parts = D.id_parts(F.col("doc_id"))
    return d.select(
        "doc_id",
        P.valid_dni_nie(parts["dni"]).alias("dni_ok"),
        P.valid_dni_nie(parts["nie"]).alias("nie_ok"),
        P.valid_nss(parts["nss"]).alias("nss_ok"),
        P.valid_cif(parts["cif"]).alias("cif_ok"),
        P.valid_iban_es(parts["iban"]).alias("iban_ok"),
        P.valid_luhn(parts["card"]).alias("card_ok"),
    )


def _redact_query_sql(src_sql: str, id_col: str, text_col: str, keys: list[str], extra: str = "") -> str:
    ctes, last = S.redact_ctes("r_src", keys)
    return f"""WITH r_src AS (SELECT {id_col} AS id{extra}, {text_col} AS t FROM ({src_sql})),
{ctes}
SELECT id AS {id_col}{extra}, t AS text FROM {last}"""


@register(
    "redact_ids",
    "D1-D7, D10, R1, R4 on documents with injected IDs",
    _redact_query_sql(D.ID_DOCUMENTS_SQL, "doc_id", "text", ID_KEYS),
)
def q_redact_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = D.id_documents(spark, sf)
    return d.select("doc_id", P.redact(F.col("text"), ID_KEYS).alias("text"))


@register(
    "redact_default",
    "D8, D9, D11, R4 with the default entity set (P9) on documents",
    _redact_query_sql("SELECT * FROM documents", "doc_id", "text", DEFAULT_KEYS),
)
def q_redact_default(spark: SparkSession, sf: str) -> DataFrame:
    d = D.table(spark, sf, "documents")
    return d.select("doc_id", P.redact(F.col("text"), DEFAULT_KEYS).alias("text"))


@register(
    "redact_conversations",
    "R5 on another text column (conversations), adds anonymized",
    _redact_query_sql("SELECT *, conv_id * 1000 + turn AS k FROM conversations", "k", "text", DEFAULT_KEYS, ", conv_id, turn, role")
    .replace("SELECT id AS k, conv_id, turn, role, t AS text", "SELECT conv_id, turn, role, t AS text, true AS anonymized"),
)
def q_redact_conversations(spark: SparkSession, sf: str) -> DataFrame:
    c = D.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return OP.redact_columns(c, ["text"], DEFAULT_KEYS)


_SPANS_SQL = S.spans_sql("s_src", ALL_KEYS)


@register(
    "detect_pii",
    "R2 (spans with code-point offsets, validated matches only)",
    f"""WITH s_src AS (SELECT doc_id AS id, text AS t FROM ({D.ID_DOCUMENTS_SQL}))
SELECT id AS doc_id, entity, "start", "end", score, matched FROM ({_SPANS_SQL})""",
)
def q_detect_pii(spark: SparkSession, sf: str) -> DataFrame:
    return OP.detect_pii(D.id_documents(spark, sf), "text", ALL_KEYS)


_SPAN_STRUCT = "STRUCT(entity VARCHAR, st INTEGER, en INTEGER, score DOUBLE, matched VARCHAR)"
_RESOLVED_ORACLE = f"""WITH s_src AS (SELECT doc_id AS id, text AS t FROM ({D.ID_DOCUMENTS_SQL})),
sp AS ({_SPANS_SQL}),
grp AS (SELECT id, list(struct_pack(entity := entity, st := "start", en := "end", score := score, matched := matched)
          ORDER BY "start", "end" DESC, score DESC, entity) AS ss FROM sp GROUP BY id),
res AS (SELECT id, list_reduce(ss, lambda acc, x: CASE WHEN x.st >= acc.reach THEN {{'reach': x.en, 'out': list_append(acc.out, x)}}
          WHEN x.en <= acc.reach THEN acc
          WHEN x.entity = acc.out[-1].entity THEN {{'reach': x.en, 'out': list_append(acc.out[1:len(acc.out) - 1], struct_pack(entity := x.entity,
            st := acc.out[-1].st, en := x.en, score := greatest(acc.out[-1].score, x.score),
            matched := acc.out[-1].matched || substr(x.matched, acc.reach - x.st + 1)))}}
          ELSE {{'reach': x.en, 'out': list_append(acc.out, struct_pack(entity := x.entity, st := acc.reach, en := x.en, score := x.score,
            matched := substr(x.matched, acc.reach - x.st + 1)))}} END,
          {{'reach': 0, 'out': []::{_SPAN_STRUCT}[]}}).out AS kept FROM grp),
u AS (SELECT id, unnest(kept) AS k FROM res)
SELECT id AS doc_id, k.entity AS entity, k.st AS "start", k.en AS "end", k.score AS score, k.matched AS matched FROM u"""


@register(
    "resolve_overlaps",
    "R3 (inside an earlier, longer or better span: dropped; beyond it: merged when of its type, else cut to the free part)",
    _RESOLVED_ORACLE,
)
def q_resolve_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return OP.detect_pii(D.id_documents(spark, sf), "text", ALL_KEYS, resolve=True)


@register(
    "pii_summary",
    "A4 (spans and documents per source and entity, rollup-free)",
    f"""WITH s_src AS (SELECT doc_id AS id, text AS t FROM ({D.ID_DOCUMENTS_SQL}))
SELECT d.source, sp.entity, count(*) AS n_spans, count(DISTINCT sp.id) AS n_docs
FROM ({_SPANS_SQL}) sp JOIN documents d ON sp.id = d.doc_id GROUP BY d.source, sp.entity""",
)
def q_pii_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = D.id_documents(spark, sf)
    return OP.pii_counts(d, "text", ALL_KEYS, ("source",)).select("source", "entity", "n_spans", "n_docs")


# The entity requests given to document i are REQUESTS[i % 5].
REQUESTS = ["email,person, dni_nie", "", "iban,,unknown_key,email", " phone , ip,phone", "location,date,credit_card,company_id"]


def _requests_col():
    return F.element_at(F.array(*[F.lit(r) for r in REQUESTS]), (F.col("doc_id") % len(REQUESTS) + 1).cast("int"))


def _requests_sql() -> str:
    return "[" + ", ".join(S.sql_str(r) for r in REQUESTS) + f"][doc_id % {len(REQUESTS)} + 1]"


_TAG_CASE = "CASE " + " ".join(f"WHEN k = '{k}' THEN '{t}'" for k, _, _, t, _ in C.PII_ENTITIES) + " END"
_KNOWN_SQL = "[" + ", ".join(f"'{k}'" for k, *_ in C.PII_ENTITIES) + "]"
_DEFAULT_SQL = "[" + ", ".join(f"'{k}'" for k in DEFAULT_KEYS) + "]"


@register(
    "requested_entities",
    "P7, P8, P9, J2 (parse the request, keep known keys in order, map to tags)",
    f"""WITH r AS (SELECT doc_id, {_requests_sql()} AS raw FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x: x <> '') AS parsed FROM r),
k0 AS (SELECT doc_id, parsed, list_filter(parsed, lambda x: list_contains({_KNOWN_SQL}, x)) AS k0 FROM p),
k AS (SELECT doc_id, parsed, list_filter(k0, lambda x, i: list_position(k0, x) = i) AS known FROM k0)
SELECT doc_id, array_to_string(parsed, ',') AS parsed, array_to_string(known, ',') AS known,
       array_to_string(list_transform(known, lambda k: {_TAG_CASE}), ',') AS tags,
       CAST(len(list_filter(known, lambda x: list_contains({_DEFAULT_SQL}, x))) AS INTEGER) AS n_default
FROM k""",
)
def q_requested_entities(spark: SparkSession, sf: str) -> DataFrame:
    d = D.table(spark, sf, "documents").select("doc_id")
    parsed = OP.parse_entities(_requests_col())
    known = OP.known_entities(parsed)
    return d.select(
        "doc_id",
        F.array_join(parsed, ",").alias("parsed"),
        F.array_join(known, ",").alias("known"),
        F.array_join(OP.entity_tags(known), ",").alias("tags"),
        F.size(F.filter(known, lambda x: F.array_contains(OP.default_entities(), x))).alias("n_default"),
    )


# =========================================================================== HTML, tables, extraction


@register("html_to_markdown", "X4 over every page", f"SELECT page_id, {S.html_sql('html')} AS markdown FROM pages")
def q_html_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    p = D.table(spark, sf, "pages")
    return p.select("page_id", html_to_markdown(F.col("html")).alias("markdown"))


def _cell_sql(c: str) -> str:
    return f"regexp_replace(replace(coalesce(CAST({c} AS VARCHAR), ''), '|', {S.sql_str(chr(92) + '|')}), {S.q(chr(13) + chr(10) + '?|' + chr(10))}, ' ', 'g')"


@register(
    "table_to_markdown",
    "X5 (nations of each region as a pipe table)",
    f"""SELECT r.r_regionkey, r.r_name,
       {S.sql_str('| n_nationkey | n_name |' + chr(10) + '| --- | --- |' + chr(10))} ||
       string_agg('| ' || {_cell_sql('n.n_nationkey')} || ' | ' || {_cell_sql('n.n_name')} || ' |', chr(10) ORDER BY n.n_nationkey) AS markdown
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_regionkey, r.r_name""",
)
def q_table_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    n = D.table(spark, sf, "nation")
    r = D.table(spark, sf, "region")
    # no hint: Spark broadcasts the side whose measured size is under its threshold
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    return table_to_markdown(j, ["r_regionkey", "r_name"], ["n_nationkey"], ["n_nationkey", "n_name"])


PART_ROWS = 1000
LINE_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_linestatus"]


@register(
    "table_parts",
    "X5 (line items of each return flag as one pipe table of any height, in parts of 1,000 rows)",
    f"""WITH r AS (SELECT l_returnflag, {" || ' | ' || ".join(_cell_sql(c) for c in LINE_COLS)} AS line, l_orderkey, l_linenumber FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, line) - 1 AS place FROM r)
SELECT l_returnflag, place // {PART_ROWS} AS part, count(*) AS n_rows,
       (CASE WHEN place // {PART_ROWS} = 0 THEN {S.sql_str('| ' + ' | '.join(LINE_COLS) + ' |' + chr(10) + '| --- | --- | --- | --- |' + chr(10))} ELSE '' END) ||
       string_agg('| ' || line || ' |', chr(10) ORDER BY place) AS markdown
FROM n GROUP BY l_returnflag, place // {PART_ROWS}""",
)
def q_table_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.table(spark, sf, "lineitem").select("l_returnflag", *LINE_COLS)
    return table_parts(rows, ["l_returnflag"], ["l_orderkey", "l_linenumber"], LINE_COLS, PART_ROWS)


# Each document as a CSV text with quoted line ends, commas and quotes, an empty record and a short one.
_CSV_PIECES = ("doc_id,source,text\\r\\n", ',"', '"\\r\\n\\n', ',"a ""b"", |c|",', "\\n")


def _csv_text_sql() -> str:
    head, open_, close, more, end = (S.sql_str(x.encode().decode("unicode_escape")) for x in _CSV_PIECES)
    quote = S.sql_str('"')
    text = f"replace(text, {quote}, {quote} || {quote})"
    return f"({head} || doc_id || ',' || source || {open_} || {text} || {close} || doc_id || {more} || lang || {end} || source)"


@register("csv_to_markdown", "X5, X6 (every document as a CSV file, as a pipe table)", f"SELECT doc_id, {S.csv_sql('c')} AS markdown FROM (SELECT doc_id, {_csv_text_sql()} AS c FROM documents)")
def q_csv_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    from docprep.functions.csv import csv_to_markdown

    head, open_, close, more, end = (F.lit(x.encode().decode("unicode_escape")) for x in _CSV_PIECES)
    d, doc_id = D.table(spark, sf, "documents"), F.col("doc_id").cast("string")
    text = F.replace("text", F.lit('"'), F.lit('""'))
    csv = F.concat(head, doc_id, F.lit(","), "source", open_, text, close, doc_id, more, "lang", end, "source")
    return d.select("doc_id", csv_to_markdown(csv).alias("markdown"))


@register(
    "extraction_routes",
    "X1, X2, X6, X7 (route per file, native extraction with fallback to the raw text)",
    f"""WITH {_admission_sql_ctes()},
ex AS (SELECT doc_id, ext, text,
         CASE WHEN lower(ext) IN ('.jpg','.jpeg','.png','.gif','.bmp','.webp') THEN 'ocr' WHEN lower(ext) = '.pdf' THEN 'pdf' ELSE 'general' END AS route,
         CASE WHEN lower(ext) IN ('.txt','.md','.json','.xml') THEN text WHEN lower(ext) = '.csv' THEN {S.csv_sql('text')}
              WHEN lower(ext) IN ('.html','.htm') THEN {S.html_sql('text')} END AS primary_text FROM fn)
SELECT doc_id, route,
       CASE WHEN regexp_matches(coalesce(primary_text, ''), {S.q('[^' + S.WS[1:-1] + ']')}) THEN primary_text
            ELSE regexp_replace(text, {S.q('^' + S.WS + '+|' + S.WS + '+' + chr(92) + 'z')}, '', 'g') END AS extracted
FROM ex""",
)
def q_extraction_routes(spark: SparkSession, sf: str) -> DataFrame:
    f = A.with_names(D.files(spark, sf))
    primary = X.native_extract(F.col("ext"), F.col("text"))
    return f.select(
        "doc_id",
        X.route(F.col("ext")).alias("route"),
        X.with_fallback(primary, X.trim_extracted(X.text_passthrough(F.encode("text", "UTF-8")))).alias("extracted"),
    )


# The bundle entry name given to file i is BUNDLE_NAMES[ord % 6].
BUNDLE_NAMES = ["doc.md", "doc", "doc (2).md", "doc.md", "informe.MD", "../x/doc.md"]


# =========================================================================== the pipeline

PIPELINE_ENTITIES = "email, person,,dni_nie,unknown_key"
PIPELINE_KEYS = [k.strip() for k in PIPELINE_ENTITIES.split(",") if k.strip()]


def _pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(D.files(spark, sf, id_text=True), anonymize=True, entities=PIPELINE_ENTITIES, compact=True)


def _pipeline_sql_ctes() -> str:
    adm = _admission_sql_ctes().replace(f"f AS ({D.FILES_SQL})", f"f AS ({D.FILES_ID_SQL})")
    native = "('.txt','.md','.json','.xml','.csv','.html','.htm')"
    rctes, rlast = S.redact_ctes("r_src", PIPELINE_KEYS, "pr")
    cctes, cout = S.compact_ctes("c_src", "pc")
    msgs = (
        "CASE code "
        + " ".join(
            f"WHEN '{k}' THEN {S.sql_str(m)}"
            for k, m in (
                ("UNSUPPORTED_FORMAT", C.UNSUPPORTED_MESSAGE),
                ("FILE_TOO_LARGE", C.TOO_LARGE_MESSAGE),
                ("TOO_MANY_FILES", C.TOO_MANY_MESSAGE),
                ("BATCH_TOO_LARGE", C.BATCH_TOO_LARGE_MESSAGE),
                ("EMPTY_BATCH", C.EMPTY_MESSAGE),
                ("EXTRACTOR_UNAVAILABLE", C.EXTRACTOR_MESSAGE),
            )
        )
        + " END"
    )
    return f"""{adm},
ex AS (SELECT adm.*,
         CASE WHEN error_code IS NULL AND lower(ext) IN ('.txt','.md','.json','.xml') THEN text
              WHEN error_code IS NULL AND lower(ext) = '.csv' THEN {S.csv_sql('text')}
              WHEN error_code IS NULL AND lower(ext) IN ('.html','.htm') THEN {S.html_sql('text')} END AS raw,
         CASE WHEN error_code IS NULL AND lower(ext) NOT IN {native} THEN 'EXTRACTOR_UNAVAILABLE' ELSE error_code END AS code
       FROM adm),
r_src AS (SELECT doc_id AS id, raw AS t FROM ex WHERE code IS NULL),
{rctes},
c_src AS (SELECT id, t FROM {rlast}),{cctes},
pipeline AS (
  SELECT ex.doc_id, ex.batch_id, ex.ord, ex.safe_name AS original_filename,
         CASE WHEN ex.code IS NULL THEN ex.format END AS format, ex.ext AS extension,
         c.out AS markdown_content, CASE WHEN ex.code IS NULL THEN ex.markdown_filename END AS markdown_filename,
         CASE WHEN ex.code IS NULL THEN true END AS anonymized,
         CASE WHEN ex.code IS NULL THEN CAST(length(r.t) AS BIGINT) END AS original_chars,
         CASE WHEN ex.code IS NULL THEN true END AS compacted,
         CASE WHEN ex.code IS NULL THEN 'success' ELSE 'error' END AS status,
         ex.code AS error_code, {msgs} AS error, {_status_sql('ex.code')} AS http_status
  FROM ex LEFT JOIN {rlast} r ON ex.doc_id = r.id LEFT JOIN {cout} c ON ex.doc_id = c.id)"""


_PIPE = _pipeline_sql_ctes()
_RESULT_COLS = "batch_id, ord, original_filename, format, extension, markdown_content, markdown_filename, anonymized, original_chars, compacted, status, error_code, error, http_status"


@register("prepare", "PL1 (admission, extraction, redaction, length, compaction; one row per file)", f"WITH {_PIPE}\nSELECT {_RESULT_COLS} FROM pipeline")
def q_prepare(spark: SparkSession, sf: str) -> DataFrame:
    return _pipeline(spark, sf)


@register(
    "batch_summary",
    "A1 over the pipeline",
    f"""WITH {_PIPE}
SELECT batch_id, count(*) AS total_files, count_if(status = 'success') AS successful, count_if(status = 'error') AS failed
FROM pipeline GROUP BY batch_id""",
)
def q_batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    return A.batch_summary(_pipeline(spark, sf))


@register(
    "error_summary",
    "A2, P10 over the pipeline",
    f"""WITH {_PIPE}
SELECT error_code, count(*) AS n_errors, min(http_status) AS http_status FROM pipeline WHERE status = 'error' GROUP BY error_code""",
)
def q_error_summary(spark: SparkSession, sf: str) -> DataFrame:
    return A.error_summary(_pipeline(spark, sf))


@register(
    "order_results",
    "W1, U1 (listing position: results first, then errors, in input order)",
    f"""WITH {_PIPE},
lvl AS (SELECT *, coalesce(error_code IN ('TOO_MANY_FILES', 'BATCH_TOO_LARGE'), false) AS batch_level FROM pipeline)
SELECT batch_id, ord, status,
       CASE WHEN batch_level THEN NULL ELSE CAST(row_number() OVER (PARTITION BY batch_id, batch_level
            ORDER BY CASE WHEN status = 'success' THEN 0 ELSE 1 END, ord) - 1 AS INTEGER) END AS position
FROM lvl""",
)
def q_order_results(spark: SparkSession, sf: str) -> DataFrame:
    return A.order_results(_pipeline(spark, sf)).select("batch_id", "ord", "status", F.col("position").cast("int").alias("position"))


@register(
    "batch_envelope",
    "S9 (per batch: results and errors in input order, counts, JSON; a batch rejected whole has only its error)",
    f"""WITH {_PIPE},
lvl AS (SELECT *, coalesce(error_code IN ('TOO_MANY_FILES', 'BATCH_TOO_LARGE'), false) AS batch_level FROM pipeline),
env AS (SELECT batch_id,
          list(struct_pack(original_filename := original_filename, markdown_filename := markdown_filename, status := status) ORDER BY ord)
            FILTER (WHERE status = 'success' AND NOT batch_level) AS results,
          list(struct_pack(filename := original_filename, error := error) ORDER BY ord) FILTER (WHERE status = 'error' AND NOT batch_level) AS errors,
          count(*) AS total_files, count_if(status = 'success') AS successful, count_if(status = 'error') AS failed,
          max(error) FILTER (WHERE batch_level) AS batch_error
        FROM lvl GROUP BY batch_id)
SELECT batch_id, total_files, successful, failed,
       CAST(len(coalesce(results, [])) AS INTEGER) AS n_results, CAST(len(coalesce(errors, [])) AS INTEGER) AS n_errors, batch_error
FROM env""",
)
def q_batch_envelope(spark: SparkSession, sf: str) -> DataFrame:
    env = batch_envelope(_pipeline(spark, sf))
    return env.select(
        "batch_id",
        "total_files",
        "successful",
        "failed",
        F.when(F.col("results").isNull(), 0).otherwise(F.size("results")).alias("n_results"),
        F.when(F.col("errors").isNull(), 0).otherwise(F.size("errors")).alias("n_errors"),
        "batch_error",
    ).where(F.col("json").isNotNull())


def _unique_names_oracle() -> str:
    names = "[" + ", ".join(S.sql_str(n) for n in BUNDLE_NAMES) + f"][ord % {len(BUNDLE_NAMES)} + 1]"
    return f"""WITH {_PIPE},
named AS (SELECT batch_id, ord, {S.ensure_md_sql(S.safe_filename_sql(names))} AS name FROM pipeline WHERE status = 'success'),
u AS (SELECT batch_id, list(ord ORDER BY ord) AS ords, list(name ORDER BY ord) AS names FROM named GROUP BY batch_id),
r AS (SELECT batch_id, ords, names, list_reduce(names, lambda acc, x: list_append(acc, CASE WHEN NOT list_contains(acc, x) THEN x
        ELSE list_filter(list_transform(range(2, len(acc) + 3), lambda i: CANDIDATE), lambda c: NOT list_contains(acc, c))[1] END),
        []::VARCHAR[]) AS uniq FROM u)
SELECT batch_id, unnest(ords) AS ord, unnest(names) AS name, unnest(uniq) AS zip_name FROM r""".replace("CANDIDATE", CANDIDATE_SQL)


CANDIDATE_SQL = """CASE WHEN NOT contains(x, '.') THEN x || ' (' || CAST(i AS VARCHAR) || ')'
     WHEN regexp_extract(x, '(?s)\\.([^.]*)\\z', 1) = '' THEN regexp_replace(x, '(?s)\\.[^.]*\\z', '') || ' (' || CAST(i AS VARCHAR) || ')'
     ELSE regexp_replace(x, '(?s)\\.[^.]*\\z', '') || ' (' || CAST(i AS VARCHAR) || ').' || regexp_extract(x, '(?s)\\.([^.]*)\\z', 1) END"""


@register(
    "unique_names",
    "N1, N5, N6 (bundle member names in admitted batches)",
    _unique_names_oracle(),
)
def q_unique_names(spark: SparkSession, sf: str) -> DataFrame:
    from docprep.functions.names import ensure_md, safe_filename

    ok = _pipeline(spark, sf).filter(F.col("status") == "success")
    named = ok.withColumn(
        "name",
        ensure_md(safe_filename(F.element_at(F.array(*[F.lit(n) for n in BUNDLE_NAMES]), (F.col("ord") % len(BUNDLE_NAMES) + 1).cast("int")))),
    )
    return unique_names(named.select("batch_id", "ord", "name"), out_col="zip_name")


_RESULT_JSON = ", ".join(f"'{c}': {c}" for c in RESULT_FIELDS)


@register(
    "envelope_lines",
    "S9 (every result, error and count of every batch as JSON, a row each with its position)",
    f"""WITH {_PIPE},
lvl AS (SELECT *, coalesce(error_code IN ('TOO_MANY_FILES', 'BATCH_TOO_LARGE'), false) AS batch_level FROM pipeline),
tot AS (SELECT batch_id, count(*) AS total_files, count_if(status = 'success') AS successful, count_if(status = 'error') AS failed,
          max(error) FILTER (WHERE batch_level) AS detail FROM lvl GROUP BY batch_id)
SELECT batch_id, CASE WHEN status = 'success' THEN 'results' ELSE 'errors' END AS section,
       CAST(row_number() OVER (PARTITION BY batch_id, status ORDER BY ord) - 1 AS INTEGER) AS position,
       CASE WHEN status = 'success' THEN CAST(to_json({{{_RESULT_JSON}}}) AS VARCHAR)
            ELSE CAST(to_json({{'filename': original_filename, 'error': error}}) AS VARCHAR) END AS json
FROM lvl WHERE NOT batch_level
UNION ALL
SELECT batch_id, CASE WHEN detail IS NULL THEN 'counts' ELSE 'detail' END, 0,
       CASE WHEN detail IS NULL THEN CAST(to_json({{'total_files': total_files, 'successful': successful, 'failed': failed}}) AS VARCHAR)
            ELSE CAST(to_json({{'detail': detail}}) AS VARCHAR) END FROM tot""",
)
def q_envelope_lines(spark: SparkSession, sf: str) -> DataFrame:
    return envelope_lines(_pipeline(spark, sf))


# a limit that some batches of the tables are over and others are not
SMALL_BATCH_BYTES = 150 * 1024 * 1024


@register(
    "batch_bytes",
    "P4, P10 (batches over a limit of bytes, with codes, messages and statuses)",
    f"""WITH {_admission_sql_ctes().replace(f"> {C.MAX_BATCH_BYTES}", f"> {SMALL_BATCH_BYTES}")}
SELECT batch_id, ord, error_code, {_status_sql('error_code')} AS http_status,
       CASE error_code WHEN 'TOO_MANY_FILES' THEN {S.sql_str(C.TOO_MANY_MESSAGE)} WHEN 'BATCH_TOO_LARGE' THEN {S.sql_str(C.BATCH_TOO_LARGE_MESSAGE)}
            WHEN 'UNSUPPORTED_FORMAT' THEN {S.sql_str(C.UNSUPPORTED_MESSAGE)} WHEN 'FILE_TOO_LARGE' THEN {S.sql_str(C.TOO_LARGE_MESSAGE)} END AS error
FROM adm""",
)
def q_batch_bytes(spark: SparkSession, sf: str) -> DataFrame:
    named = A.with_format(A.with_names(D.files(spark, sf)))
    return A.admit(named, max_batch_bytes=SMALL_BATCH_BYTES).select("batch_id", "ord", "error_code", "http_status", "error")


@register(
    "anonymizer_missing",
    "P10, PL1 (a requested entity without a source: no file passes with an incomplete redaction)",
    f"""WITH {_PIPE},
p AS (SELECT batch_id, ord, coalesce(error_code, 'ANONYMIZER_UNAVAILABLE') AS error_code,
        coalesce(error, {S.sql_str(C.ANONYMIZER_MESSAGE + 'location')}) AS error FROM pipeline)
SELECT batch_id, ord, 'error' AS status, CAST(NULL AS VARCHAR) AS markdown_content, error_code, error, {_status_sql('error_code')} AS http_status FROM p""",
)
def q_anonymizer_missing(spark: SparkSession, sf: str) -> DataFrame:
    out = prepare(D.files(spark, sf, id_text=True), anonymize=True, entities="email, location", compact=True)
    return out.select("batch_id", "ord", "status", "markdown_content", "error_code", "error", "http_status")


@register(
    "dedupe_files",
    "A3 (first file per batch, name and size; contents not compared)",
    f"""WITH f AS ({D.FILES_SQL}),
g AS (SELECT doc_id, batch_id, ord, 'f' || CAST(doc_id % 5 AS VARCHAR) || '.md' AS filename, CAST(length(text) % 2 AS BIGINT) AS length FROM f)
SELECT batch_id, filename, length, arg_min(ord, ord) AS ord, arg_min(doc_id, ord) AS doc_id FROM g GROUP BY batch_id, filename, length""",
)
def q_dedupe_files(spark: SparkSession, sf: str) -> DataFrame:
    f = D.files(spark, sf).select(
        "doc_id",
        "batch_id",
        "ord",
        F.concat(F.lit("f"), (F.col("doc_id") % 5).cast("string"), F.lit(".md")).alias("filename"),
        (F.length("text") % 2).cast("long").alias("length"),
    )
    return A.dedupe_files(f).select("batch_id", "filename", "length", "ord", "doc_id")


@register(
    "assign_batches",
    "W4 (batches of at most 50 within each source, in order of doc_id whatever the layout)",
    """SELECT doc_id, source, source || ':' || CAST(n // 50 AS VARCHAR) AS batch_id, CAST(n % 50 AS INTEGER) AS ord
FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)""",
)
def q_assign_batches(spark: SparkSession, sf: str) -> DataFrame:
    d = D.table(spark, sf, "documents").select("doc_id", "source")
    return A.assign_ordered_batches(d, "source", ["doc_id"], 50)


@register(
    "empty_batches",
    "P5 (batch ids with no file get one EMPTY_BATCH error)",
    f"""WITH f AS ({D.FILES_SQL}),
b AS (SELECT DISTINCT batch_id + 5 AS batch_id FROM f)
SELECT batch_id, 'EMPTY_BATCH' AS error_code, {S.sql_str(C.EMPTY_MESSAGE)} AS error, 400 AS http_status
FROM b WHERE batch_id NOT IN (SELECT batch_id FROM f)""",
)
def q_empty_batches(spark: SparkSession, sf: str) -> DataFrame:
    f = D.files(spark, sf)
    requested = f.select((F.col("batch_id") + 5).alias("batch_id"))
    return A.empty_batches(requested, f)


# =========================================================================== streaming


def _documents_stream(spark: SparkSession, sf: str) -> DataFrame:
    from docprep.streaming.stream import read_stream

    schema = D.table(spark, sf, "documents").schema
    # a pattern: the table may be one file or a folder of files
    return read_stream(spark, f"{sf}/documents.parque[t]", schema)


def _stream_prepared(spark: SparkSession, sf: str) -> DataFrame:
    from docprep.streaming.stream import prepare_stream, read_prepared, read_stream, scratch

    out, ck = scratch(spark, "st1-out"), scratch(spark, "st1-ck")
    # a file a core at each trigger: batches come over several epochs, and every core has its share of each
    src, cores = scratch(spark, "st1-in"), spark.sparkContext.defaultParallelism
    docs = D.table(spark, sf, "documents")
    docs.repartition(4 * cores, "doc_id").write.parquet(src)
    q = prepare_stream(
        read_stream(spark, src, docs.schema, max_files=cores), out, ck,
        to_files=lambda b: D.files_from_documents(b, id_text=True),
        anonymize=True, entities=PIPELINE_ENTITIES, compact=True,
    )
    q.awaitTermination()
    return read_prepared(spark, out)


@register("stream_prepare", "ST1 (the pipeline over a file stream; equals the batch pipeline)", f"WITH {_PIPE}\nSELECT {_RESULT_COLS} FROM pipeline")
def q_stream_prepare(spark: SparkSession, sf: str) -> DataFrame:
    from docprep.plans.prepare import RESULT_COLUMNS

    return _stream_prepared(spark, sf).select(*RESULT_COLUMNS)


@register(
    "stream_dedupe",
    "ST2 (first file per batch, name and size within the watermark)",
    f"""WITH f AS ({D.FILES_SQL})
SELECT DISTINCT batch_id, 'f' || CAST(doc_id % 5 AS VARCHAR) || '.md' AS filename, CAST(length(text) % 2 AS BIGINT) AS length FROM f""",
)
def q_stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    from docprep.streaming.stream import dedupe_stream, scratch, write_append

    files = D.files_from_documents(_documents_stream(spark, sf)).select(
        "batch_id",
        F.concat(F.lit("f"), (F.col("doc_id") % 5).cast("string"), F.lit(".md")).alias("filename"),
        (F.length("text") % 2).cast("long").alias("length"),
        F.timestamp_seconds(F.col("batch_id") + 1700000000).alias("arrived"),
    )
    out, ck = scratch(spark, "st2-out"), scratch(spark, "st2-ck")
    write_append(dedupe_stream(files, ["batch_id", "filename", "length"], "arrived", "1 day"), out, ck).awaitTermination()
    return spark.read.parquet(out).select("batch_id", "filename", "length")


@register(
    "stream_progress",
    "ST3 (running totals per batch over the streamed pipeline output)",
    f"""WITH {_PIPE}
SELECT batch_id, count(*) AS total_files, count_if(status = 'success') AS successful, count_if(status = 'error') AS failed
FROM pipeline GROUP BY batch_id""",
)
def q_stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    from docprep.streaming.stream import latest_rows, progress_stream, read_stream, scratch, write_updates

    prepared_dir = scratch(spark, "st3-src")
    _stream_prepared(spark, sf).write.mode("overwrite").parquet(prepared_dir)
    schema = spark.read.parquet(prepared_dir).schema
    results = read_stream(spark, prepared_dir, schema)
    out, ck = scratch(spark, "st3-out"), scratch(spark, "st3-ck")
    write_updates(progress_stream(results), out, ck).awaitTermination()
    return latest_rows(spark.read.parquet(out), ["batch_id"])


def _arrivals(source: str, slices: list[DataFrame], start) -> None:
    """Slices that arrive one after another: each is written to the source and taken by one run of the query, an epoch each."""
    for part in slices:
        part.write.mode("append").parquet(source)
        start().awaitTermination()


@register(
    "stream_first",
    "ST2 (least ord per batch, name and size, though rows arrive in falling order of ord; A3's rows)",
    f"""WITH f AS ({D.FILES_SQL}),
g AS (SELECT doc_id, batch_id, ord, 'f' || CAST(doc_id % 5 AS VARCHAR) || '.md' AS filename, CAST(length(text) % 2 AS BIGINT) AS length FROM f)
SELECT batch_id, filename, length, arg_min(ord, ord) AS ord, arg_min(doc_id, ord) AS doc_id FROM g GROUP BY batch_id, filename, length""",
)
def q_stream_first(spark: SparkSession, sf: str) -> DataFrame:
    from docprep.streaming.stream import first_stream, read_stream, scratch, write_append

    # all times within 1,000 seconds, whatever the size of the input: nothing is later than the watermark's delay
    files = D.files(spark, sf).select(
        "batch_id",
        F.concat(F.lit("f"), (F.col("doc_id") % 5).cast("string"), F.lit(".md")).alias("filename"),
        (F.length("text") % 2).cast("long").alias("length"),
        "ord",
        "doc_id",
        F.timestamp_seconds(F.pmod("batch_id", F.lit(1000)) + 1700000000).alias("arrived"),
    )
    source, out, ck = scratch(spark, "st2f-in"), scratch(spark, "st2f-out"), scratch(spark, "st2f-ck")
    # a row of a later day moves the watermark past every session; its own stays open
    later = F.struct(*[F.lit(None).cast(t).alias(c) for c, t in files.dtypes if c != "arrived"], F.timestamp_seconds(F.lit(1700100000)).alias("arrived"))
    slices = [files.where(F.floor(F.col("ord") / 20) == k) for k in (3, 2, 1, 0)] + [spark.range(1).select(later.alias("s")).select("s.*")]
    keys = ["batch_id", "filename", "length"]
    _arrivals(source, slices, lambda: write_append(first_stream(read_stream(spark, source, files.schema), keys, "arrived"), out, ck))
    return spark.read.parquet(out).select(*keys, "ord", "doc_id")


@register(
    "stream_percent",
    "ST3 (done, successful, failed and percent of the announced total, for every epoch that changed a batch)",
    f"""WITH {_admission_sql_ctes()},
told AS (SELECT batch_id, count(*) AS announced FROM adm GROUP BY batch_id),
e AS (SELECT batch_id, ord % 4 AS epoch, count(*) AS n, count_if(error_code IS NULL) AS ok FROM adm GROUP BY batch_id, ord % 4),
r AS (SELECT batch_id, epoch, CAST(sum(n) OVER w AS BIGINT) AS total_files, CAST(sum(ok) OVER w AS BIGINT) AS successful
      FROM e WINDOW w AS (PARTITION BY batch_id ORDER BY epoch))
SELECT r.batch_id, CAST(epoch AS BIGINT) AS epoch, total_files, successful, total_files - successful AS failed, announced,
       CAST((200 * total_files + announced) // (2 * announced) AS BIGINT) AS percent
FROM r JOIN told ON r.batch_id = told.batch_id""",
)
def q_stream_percent(spark: SparkSession, sf: str) -> DataFrame:
    from docprep.streaming.stream import progress_stream, read_stream, scratch, write_updates

    admitted = A.admit(A.with_format(A.with_names(D.files(spark, sf))))
    done = admitted.select("batch_id", "ord", F.when(F.col("error_code").isNull(), "success").otherwise("error").alias("status"))
    announced = D.files(spark, sf).groupBy("batch_id").agg(F.count(F.lit(1)).alias("announced"))
    source, out, ck = scratch(spark, "st3p-in"), scratch(spark, "st3p-out"), scratch(spark, "st3p-ck")
    slices = [done.where(F.col("ord") % 4 == k) for k in range(4)]
    _arrivals(source, slices, lambda: write_updates(progress_stream(read_stream(spark, source, done.schema), announced=announced), out, ck))
    return spark.read.parquet(out).withColumn("epoch", F.col("epoch").cast("long"))


# =========================================================================== sources and sinks


# The extension of file i is FILE_KINDS[i % 8]: text, Markdown, HTML, text that is not UTF-8, a codec's file, one
# that its codec fails on, one without a codec, one of no known format. File 104 of each thousand is over the size limit.
FILE_KINDS = [".txt", ".md", ".html", ".txt", ".pdf", ".pdf", ".docx", ".exe"]
BROKEN = "page tree is broken"


def _page_codec():
    """A codec for the query's files: text between blanks, or a failure."""

    def handler(raw: bytes) -> str:
        if raw.startswith(b"!"):
            raise ValueError(BROKEN)
        return "\n # " + raw.decode() + " \n"

    return handler


def _files_sql() -> str:
    kinds = "[" + ", ".join(S.sql_str(k) for k in FILE_KINDS) + "]"
    strip = f"regexp_replace(chr(10) || ' # ' || coalesce(text, '') || ' ' || chr(10), {S.q('^' + S.WS + '+|' + S.WS + '+' + chr(92) + 'z')}, '', 'g')"
    ctes, out = S.compact_ctes("bp_src", "bp")
    return f"""WITH d0 AS (SELECT doc_id, text, doc_id % 8 AS k, {kinds}[doc_id % 8 + 1] AS ext,
         doc_id // 40 - CASE WHEN (doc_id // 40) % 10 = 9 THEN 1 ELSE 0 END AS batch_id FROM documents),
d AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY batch_id) > 50 THEN 'TOO_MANY_FILES' WHEN k = 7 THEN 'UNSUPPORTED_FORMAT'
         WHEN doc_id % 1000 = 104 THEN 'FILE_TOO_LARGE' WHEN k IN (3, 5) THEN 'FAILED' WHEN k = 6 THEN 'EXTRACTOR_UNAVAILABLE' END AS code FROM d0),
raw AS (SELECT doc_id AS id, CASE WHEN k IN (0, 1) THEN coalesce(text, '') WHEN k = 2 THEN {S.html_sql("coalesce(text, '')")} ELSE {strip} END AS t FROM d WHERE code IS NULL),
bp_src AS (SELECT id, t FROM raw),{ctes}
SELECT CAST(d.batch_id AS BIGINT) AS batch_id, CAST(d.doc_id AS INTEGER) AS ord, d.doc_id || d.ext AS original_filename, d.ext AS extension, o.out AS markdown_content,
  CAST(length(raw.t) AS BIGINT) AS original_chars, CASE WHEN code IS NULL THEN 'success' ELSE 'error' END AS status, code AS error_code,
  CASE code WHEN 'TOO_MANY_FILES' THEN {S.sql_str(C.TOO_MANY_MESSAGE)} WHEN 'UNSUPPORTED_FORMAT' THEN {S.sql_str(C.UNSUPPORTED_MESSAGE)}
    WHEN 'FILE_TOO_LARGE' THEN {S.sql_str(C.TOO_LARGE_MESSAGE)} WHEN 'EXTRACTOR_UNAVAILABLE' THEN {S.sql_str(C.EXTRACTOR_MESSAGE)}
    WHEN 'FAILED' THEN CASE k WHEN 3 THEN {S.sql_str(NOT_UTF8)} ELSE {S.sql_str(BROKEN)} END END AS error, {_status_sql('code')} AS http_status
FROM d LEFT JOIN raw ON raw.id = d.doc_id LEFT JOIN {out} o ON o.id = d.doc_id"""


@register("prepare_files", "PL1, X3, U4, S1, P10 (documents written as files, read back as bytes; codecs in workers, failures as rows)", _files_sql())
def q_prepare_files(spark: SparkSession, sf: str) -> DataFrame:
    from docprep.sources.readers import read_files
    from docprep.sources.sinks import write_blank_files, write_files
    from docprep.streaming.stream import scratch

    d = D.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind, block = F.col("doc_id") % 8, F.floor(F.col("doc_id") / 40)
    batch = block - F.when(block % 10 == 9, 1).otherwise(0)
    body = F.col("text").cast("binary")
    over = F.coalesce(F.col("doc_id") % 1000 == 104, F.lit(False))
    content = (
        F.when(kind == 3, F.concat(F.lit(b"\xff\xfe"), body))
        .when(kind == 5, F.concat(F.lit(b"!"), body))
        .otherwise(body)
    )
    name = F.concat(F.col("doc_id").cast("string"), F.element_at(F.array(*[F.lit(k) for k in FILE_KINDS]), (kind + 1).cast("int")))
    folder = scratch(spark, "files-in")
    path = F.concat(F.lit("batch="), batch.cast("string"), F.lit("/"), name).alias("path")
    write_files(d.where(~over).select(path, content.alias("content")), folder)
    write_blank_files(d.where(over).select(path, F.lit(C.MAX_FILE_SIZE + 1).alias("length")), folder)
    # a file a document: the executors list them, and prepare reads their bytes
    files = read_files(spark, folder, with_content=False, listing=scratch(spark, "files-list"))
    files = files.withColumn("batch_id", F.regexp_extract("path", "/batch=(-?[0-9]+)/", 1).cast("long"))
    files = files.withColumn("ord", F.regexp_extract("filename", "^-?[0-9]+", 0).cast("int")).drop("ext")
    before = X.registered_extractors()
    X.clear_extractors()
    X.register_extractor(".pdf", _page_codec)
    try:
        out = prepare(files, compact=True, text_col=None, content_col="content")
    finally:
        X.restore_extractors(before)
    columns = ("batch_id", "ord", "original_filename", "extension", "markdown_content", "original_chars", "status", "error_code", "error", "http_status")
    return out.select(*columns)


@register(
    "write_markdown",
    "S7, S10 (successful documents written as compressed parquet partitioned by format, read back)",
    f"""WITH {_PIPE}
SELECT batch_id, ord, markdown_filename, markdown_content, format FROM pipeline WHERE status = 'success'""",
)
def q_write_markdown(spark: SparkSession, sf: str) -> DataFrame:
    from docprep.sources.sinks import write_markdown
    from docprep.streaming.stream import scratch

    path = scratch(spark, "markdown")
    write_markdown(_pipeline(spark, sf), path, partition_by="format", compression="zstd")
    return spark.read.parquet(path).select("batch_id", "ord", "markdown_filename", "markdown_content", "format")


@register(
    "export_bundles",
    "S8, N1, N5, N6 (one deflate archive per batch of successful documents; every member's place, name, size and digest)",
    f"""WITH {_PIPE},
named AS (SELECT batch_id, ord, markdown_content, {S.ensure_md_sql(S.safe_filename_sql('markdown_filename'))} AS name FROM pipeline WHERE status = 'success'),
u AS (SELECT batch_id, list(markdown_content ORDER BY ord) AS texts, list(name ORDER BY ord) AS names FROM named GROUP BY batch_id),
r AS (SELECT batch_id, texts, list_reduce(names, lambda acc, x: list_append(acc, CASE WHEN NOT list_contains(acc, x) THEN x
        ELSE list_filter(list_transform(range(2, len(acc) + 3), lambda i: CANDIDATE), lambda c: NOT list_contains(acc, c))[1] END),
        []::VARCHAR[]) AS uniq FROM u),
m AS (SELECT batch_id, unnest(range(len(uniq))) AS place, unnest(uniq) AS member, unnest(texts) AS t FROM r)
SELECT batch_id, place, member, CAST(strlen(t) AS BIGINT) AS n_bytes, md5(t) AS digest FROM m""".replace("CANDIDATE", CANDIDATE_SQL),
)
def q_export_bundles(spark: SparkSession, sf: str) -> DataFrame:
    from docprep.sources.sinks import bundle_contents, export_bundles

    return bundle_contents(export_bundles(_pipeline(spark, sf)))


@register("write_bundles", "S8 (archives written as streams below a folder, read back: every member's place, name, size and digest)", REGISTRY["export_bundles"].sql)
def q_write_bundles(spark: SparkSession, sf: str) -> DataFrame:
    from docprep.sources.sinks import write_bundles, written_contents
    from docprep.streaming.stream import scratch

    folder = scratch(spark, "bundles")
    return written_contents(write_bundles(_pipeline(spark, sf), folder), folder)


# =========================================================================== free-text entities, catalogue report

def _gazetteer_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Every word and every two words in a row of the benchmark's whole texts."""
    from docprep.functions.models import TOKEN_RX

    words = D.table(spark, sf, "benchmark").select(F.regexp_extract_all("text", F.lit(TOKEN_RX), 0).alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.expr("slice(w, 2, size(w))"), lambda a, b: F.concat_ws(" ", a, b))
    return words.select(F.explode(F.concat("w", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>")))).alias("term"))


def _gazetteer_sql() -> str:
    from docprep.functions.models import TOKEN_RX
    from docprep.functions.pii import Recognizer

    tok = S.spans_sql("s_src", [], [Recognizer("location", TOKEN_RX, 0.85, name="token")])
    return f"""WITH s_src AS (SELECT doc_id AS id, text AS t FROM documents),
ws AS (SELECT regexp_extract_all(text, {S.q(TOKEN_RX)}, 0) AS w FROM benchmark),
terms AS (SELECT DISTINCT lower(k) AS k FROM (SELECT unnest(w) AS k FROM ws
  UNION ALL SELECT w[i] || ' ' || w[i + 1] AS k FROM (SELECT w, unnest(range(1, len(w))) AS i FROM ws))),
tok AS ({tok}),
nxt AS (SELECT *, lead("start") OVER o AS st2, lead("end") OVER o AS en2, lead(matched) OVER o AS m2 FROM tok WINDOW o AS (PARTITION BY id ORDER BY "start")),
runs AS (SELECT id, entity, "start", "end", score, matched, lower(matched) AS k FROM tok
  UNION ALL SELECT n.id, entity, "start", en2 AS "end", score, matched || substr(t, "end" + 1, 1) || m2 AS matched, lower(matched || ' ' || m2) AS k
  FROM nxt n JOIN s_src USING (id) WHERE st2 = "end" + 1)
SELECT id AS doc_id, entity, "start", "end", score, matched FROM runs WHERE k IN (SELECT k FROM terms)"""


@register("gazetteer_locations", "D12 (one- and two-word terms from the whole benchmark texts, token run join, size-checked broadcast)", _gazetteer_sql())
def q_gazetteer_locations(spark: SparkSession, sf: str) -> DataFrame:
    from docprep.functions.models import gazetteer_spans

    d = D.table(spark, sf, "documents").select("doc_id", "text")
    return gazetteer_spans(d, "text", _gazetteer_terms(spark, sf)).select("doc_id", "entity", "start", "end", "score", "matched")


LONGEST_TERM = 8


def _long_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Of the benchmark's whole texts, the run of 1 + i % 8 words that begins at word i."""
    from docprep.functions.models import TOKEN_RX

    words = D.table(spark, sf, "benchmark").select(F.regexp_extract_all("text", F.lit(TOKEN_RX), 0).alias("w"))
    runs = F.transform(F.col("w"), lambda _, i: F.array_join(F.slice("w", i + 1, 1 + i % LONGEST_TERM), " "))
    return words.select(F.explode(runs).alias("term"))


def _long_terms_sql() -> str:
    from docprep.functions.models import TOKEN_RX
    from docprep.functions.pii import Recognizer

    tok = S.spans_sql("s_src", [], [Recognizer("location", TOKEN_RX, 0.85, name="token")])
    n = range(1, LONGEST_TERM)
    leads = ", ".join(f'lead("start", {k}) OVER o AS s{k}, lead("end", {k}) OVER o AS e{k}, lead(matched, {k}) OVER o AS m{k}' for k in n)
    runs, close, words = ['SELECT id, "start", "end", lower(matched) AS k FROM nxt'], "true", "matched"
    for k in n:
        last = '"end"' if k == 1 else f"e{k - 1}"
        close, words = f"{close} AND s{k} = {last} + 1", f"{words} || ' ' || m{k}"
        runs.append(f'SELECT id, "start", e{k} AS "end", lower({words}) AS k FROM nxt WHERE {close}')
    return f"""WITH s_src AS (SELECT doc_id AS id, text AS t FROM documents),
ws AS (SELECT regexp_extract_all(text, {S.q(TOKEN_RX)}, 0) AS w FROM benchmark),
terms AS (SELECT DISTINCT lower(array_to_string(w[i + 1:i + 1 + i % {LONGEST_TERM}], ' ')) AS k FROM (SELECT w, unnest(range(len(w))) AS i FROM ws)),
tok AS ({tok}),
nxt AS (SELECT id, "start", "end", matched, {leads} FROM tok WINDOW o AS (PARTITION BY id ORDER BY "start")),
runs AS ({" UNION ALL ".join(runs)})
SELECT id AS doc_id, 'LOCATION' AS entity, r."start", r."end", CAST(0.85 AS DOUBLE) AS score, substr(t, r."start" + 1, r."end" - r."start") AS matched
FROM (SELECT * FROM runs WHERE k IN (SELECT k FROM terms)) r JOIN s_src USING (id)"""


@register("gazetteer_long_terms", "D12 (terms of one to eight words from the whole benchmark texts; runs grow while they are a term's prefix)", _long_terms_sql())
def q_gazetteer_long_terms(spark: SparkSession, sf: str) -> DataFrame:
    from docprep.functions.models import gazetteer_spans

    d = D.table(spark, sf, "documents").select("doc_id", "text")
    return gazetteer_spans(d, "text", _long_terms(spark, sf)).select("doc_id", "entity", "start", "end", "score", "matched")


_CATALOG_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{k}', '{e}', {S.sql_str(l)}, '{t}', {str(d).lower()})" for i, (k, e, l, t, d) in enumerate(C.PII_ENTITIES)
) + ") c(ordinal, key, entity, label, tag, \"default\"))"


@register(
    "entity_report",
    "S5, A4 (the 12 entity types with span and document counts)",
    f"""WITH s_src AS (SELECT doc_id AS id, text AS t FROM ({D.ID_DOCUMENTS_SQL})),
sp AS ({_SPANS_SQL}),
agg AS (SELECT entity, count(*) AS n_spans, count(DISTINCT id) AS n_docs FROM sp GROUP BY entity)
SELECT CAST(c.ordinal AS INTEGER) AS ordinal, c.key, c.label, c.tag, c."default", coalesce(a.n_spans, 0) AS n_spans, coalesce(a.n_docs, 0) AS n_docs
FROM {_CATALOG_SQL} c LEFT JOIN agg a ON c.entity = a.entity""",
)
def q_entity_report(spark: SparkSession, sf: str) -> DataFrame:
    agg = OP.pii_counts(D.id_documents(spark, sf), "text", ALL_KEYS)
    cat = C.pii_catalog(spark)
    return cat.join(agg, "entity", "left").select(
        "ordinal", "key", "label", "tag", "default",
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"),
    )
