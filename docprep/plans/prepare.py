"""PL1: the whole preparation pipeline, one result or error row per input file.

extract -> redact -> record length -> compact, after admission. Every step is
a projection except the per-batch statistics of admission (an aggregate joined
back), so the plan has one shuffle, on ``batch_id``, with map-side combine.
Files whose bytes are still on storage are dealt out as narrow rows before they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprep.functions.compact import compact_markdown
from docprep.functions.models import missing_sources, redact_with_models
from docprep.functions.pii import known_keys, redact
from docprep.operators.admission import admit, checked_rejected, error_message, http_status, with_format, with_names
from docprep.sources.catalogs import ANONYMIZER_MESSAGE, MAX_FILE_SIZE
from docprep.sources.readers import read_content
from docprep.operators.extract import NATIVE_EXTENSIONS, apply_extractors, native_extract, registered_extractors, text_passthrough

RESULT_COLUMNS = [
    "batch_id",
    "ord",
    "original_filename",
    "format",
    "extension",
    "markdown_content",
    "markdown_filename",
    "anonymized",
    "original_chars",
    "compacted",
    "status",
    "error_code",
    "error",
    "http_status",
]


def parse_entities(raw: str | None) -> list[str]:
    """P7 at plan time: 'email,person, dni_nie' -> ['email', 'person', 'dni_nie']."""
    return [p.strip() for p in (raw or "").split(",") if p.strip()]


NOT_UTF8 = "The file is not valid UTF-8 text"


def prepare(
    files: DataFrame,
    anonymize: bool = False,
    entities: str | list[str] = "",
    compact: bool = True,
    text_col: str | None = "text",
    content_col: str | None = None,
    models: dict | None = None,
    batch_limits: bool = True,
) -> DataFrame:
    """Run the pipeline over ``files`` (batch_id, ord, filename, length + text or content, or path: bytes still on storage).

    ``anonymized`` is true whenever anonymisation was asked with a non-empty
    key list, even if every key is unknown; ``original_chars`` is the length in
    code points after redaction and before compaction.

    ``models`` maps entity keys to model factories (``register_model``, ``gazetteer_model``). When a
    type of the catalogue is requested that has neither a pattern nor a model, every file that would
    succeed becomes an ANONYMIZER_UNAVAILABLE row: an incomplete redaction never passes for a whole one.
    With ``batch_limits`` off, batches over a limit are not looked for and the column ``length`` is
    kept: ``apply_batch_limits`` takes that decision later, over all parts of a stream.
    ``person`` has a source of its own, the label rule, which finds labelled names only.
    """
    keys = parse_entities(entities) if isinstance(entities, str) else list(entities)
    redact_keys = known_keys(keys) if anonymize else []
    anonymized = bool(anonymize and keys)
    asked = [k for k in keys if k in (models or {})] if anonymize else []
    unsourced = missing_sources(keys, models) if anonymize else []

    named = with_format(with_names(files))
    undecided = None if batch_limits else named.select("batch_id", F.lit("").alias("__batch_code")).where(F.lit(False))
    stored = text_col is None and content_col not in files.columns
    if stored:
        adm = admit(named, rejected=undecided)
    elif text_col is None:
        # Bytes are read only for files within the size limit: that filter is
        # pushed into the file scan, and oversized files come from a scan
        # without their content (they only need an error row). Both parts
        # share the batch decision taken over all files.
        rejected = checked_rejected(named) if undecided is None else undecided
        within = (F.col("length") <= MAX_FILE_SIZE) | F.col("length").isNull()
        small = admit(named.filter(within), rejected=rejected)
        large = admit(named.filter(~within).drop(content_col), rejected=rejected).withColumn(
            content_col, F.lit(None).cast("binary")
        )
        adm = small.unionByName(large)
    else:
        adm = admit(named, rejected=undecided).withColumn("__text", F.col(text_col))

    is_native = F.col("ext").isin(*NATIVE_EXTENSIONS)

    def with_text(rows):
        # bytes that are still on storage are read here, a file once, because no filter is pushed below that read
        if stored:
            rows = read_content(rows, content_col, MAX_FILE_SIZE)
        # only text formats are decoded; other bytes go to their handler as they are
        return rows.withColumn("__text", F.when(is_native, text_passthrough(F.col(content_col)))) if text_col is None else rows

    undecodable = F.lit(False)
    if text_col is None:
        undecodable = F.col("error_code").isNull() & is_native & F.col(content_col).isNotNull() & F.col("__text").isNull()
    here = adm.filter(F.col("error_code").isNotNull() | is_native | F.lit(not registered_extractors()))
    native = with_text(here).withColumn("__why", F.when(undecodable, F.lit(NOT_UTF8))).withColumn(
        "error_code", F.when(undecodable, F.lit("FAILED")).otherwise(F.col("error_code"))
    ).withColumns(
        {
            "__raw": F.when(F.col("error_code").isNull(), native_extract(F.col("ext"), F.col("__text"))),
            "error_code": F.when(F.col("error_code").isNull() & ~is_native, F.lit("EXTRACTOR_UNAVAILABLE")).otherwise(
                F.col("error_code")
            ),
        }
    )
    parts = [native]
    if registered_extractors():
        codec = with_text(adm.filter(F.col("error_code").isNull() & ~is_native))
        if content_col is None:
            codec = codec.withColumn("__content", F.encode(F.col("__text"), "UTF-8"))
            src = "__content"
        else:
            src = content_col
        extracted = apply_extractors(codec, src, "ext")
        extracted = extracted.withColumns({"__raw": F.col("x_text"), "error_code": F.col("x_code"), "__why": F.col("x_error")}).drop(
            "x_text", "x_code", "x_error"
        )
        if content_col is None:
            extracted = extracted.drop("__content")
        parts.append(extracted)
    staged = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    if unsourced:
        no_source = F.col("error_code").isNull()
        staged = staged.withColumn("__why", F.when(no_source, F.lit(ANONYMIZER_MESSAGE + ", ".join(unsourced))).otherwise(F.col("__why")))
        staged = staged.withColumn("error_code", F.coalesce("error_code", F.lit("ANONYMIZER_UNAVAILABLE")))

    text = F.col("__raw")
    redacted = redact_with_models(text, keys, models) if asked else redact(text, redact_keys) if redact_keys else text
    ok = F.col("error_code").isNull()
    out = staged.withColumn("__red", F.when(ok, redacted)).withColumns(
        {
            "original_chars": F.when(ok, F.length("__red").cast("long")),
            "markdown_content": F.when(ok, compact_markdown(F.col("__red")) if compact else F.col("__red")),
            "status": F.when(ok, F.lit("success")).otherwise(F.lit("error")),
            "anonymized": F.when(ok, F.lit(anonymized)),
            "compacted": F.when(ok, F.lit(compact)),
            "error": F.coalesce(error_message(F.col("error_code")), F.col("__why")),
            "http_status": http_status(F.col("error_code")),
            "original_filename": F.col("safe_name"),
            "extension": F.col("ext"),
            "format": F.when(ok, F.col("format")),
            "markdown_filename": F.when(ok, F.col("markdown_filename")),
        }
    )
    return out.select(*RESULT_COLUMNS, *([] if batch_limits else ["length"]))


def apply_batch_limits(prepared: DataFrame) -> DataFrame:
    """P3/P4 over rows prepared with ``batch_limits`` off: all rows of a batch over a limit become its error rows."""
    over, code = F.col("__batch_code").isNotNull(), F.col("__batch_code")
    rows = prepared.join(checked_rejected(prepared), "batch_id", "left")
    of_results = ("format", "markdown_content", "markdown_filename", "anonymized", "original_chars", "compacted")
    return rows.withColumns(
        {c: F.when(~over, F.col(c)) for c in of_results}
        | {
            "status": F.when(over, F.lit("error")).otherwise(F.col("status")),
            "error_code": F.coalesce(code, F.col("error_code")),
            "error": F.when(over, error_message(code)).otherwise(F.col("error")),
            "http_status": F.when(over, http_status(code)).otherwise(F.col("http_status")),
        }
    ).select(*RESULT_COLUMNS)
