"""Small fixed dimensions: supported formats, PII entity types, token platforms.

They are tiny (25, 12 and 4 rows) and fixed in code, so joining against them
with ``F.broadcast`` is always safe: their size does not grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Supported extensions and their format label, in declared order.
FORMATS: list[tuple[str, str]] = [
    (".pdf", "PDF"),
    (".docx", "Word"),
    (".doc", "Word"),
    (".pptx", "PowerPoint"),
    (".ppt", "PowerPoint"),
    (".xlsx", "Excel"),
    (".xls", "Excel"),
    (".csv", "CSV"),
    (".jpg", "Image"),
    (".jpeg", "Image"),
    (".png", "Image"),
    (".gif", "Image"),
    (".bmp", "Image"),
    (".webp", "Image"),
    (".mp3", "Audio"),
    (".wav", "Audio"),
    (".m4a", "Audio"),
    (".txt", "Text"),
    (".json", "JSON"),
    (".xml", "XML"),
    (".html", "HTML"),
    (".htm", "HTML"),
    (".md", "Markdown"),
    (".epub", "EPUB"),
    (".zip", "ZIP"),
]

# Extensions that go through OCR.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp")

# PII entity types as (key, entity, label, tag, default-on).
PII_ENTITIES: list[tuple[str, str, str, str, bool]] = [
    ("dni_nie", "ES_DNI_NIE", "DNI / NIE", "[DNI]", True),
    ("email", "EMAIL_ADDRESS", "Email", "[EMAIL]", True),
    ("person", "PERSON", "Nombre de persona", "[NOMBRE]", True),
    ("phone", "PHONE_NUMBER", "Teléfono", "[TELEFONO]", True),
    ("iban", "IBAN_CODE", "IBAN", "[IBAN]", True),
    ("credit_card", "CREDIT_CARD", "Tarjeta de crédito", "[TARJETA]", True),
    ("location", "LOCATION", "Dirección / ubicación", "[DIRECCION]", False),
    ("ip", "IP_ADDRESS", "Dirección IP", "[IP]", True),
    ("social_security", "ES_NSS", "Nº Seguridad Social", "[NSS]", True),
    ("company_id", "ES_CIF", "CIF / NIF de empresa", "[CIF]", True),
    ("vehicle_plate", "ES_PLATE", "Matrícula", "[MATRICULA]", True),
    ("date", "DATE_TIME", "Fecha", "[FECHA]", False),
]

# Token platforms as (key, label, chars per token, context window).
PLATFORMS: list[tuple[str, str, float, int]] = [
    ("chatgpt", "ChatGPT", 4.0, 128000),
    ("claude", "Claude", 3.6, 200000),
    ("gemini", "Gemini / NotebookLM", 4.0, 1000000),
    ("kimi", "Kimi", 3.8, 256000),
]

# Processing limits.
MAX_FILE_SIZE = 50 * 1024 * 1024
MAX_FILES_PER_BATCH = 50
MAX_BATCH_BYTES = MAX_FILE_SIZE * MAX_FILES_PER_BATCH
MAX_FILENAME_LEN = 255

FORMAT_SCHEMA = "ordinal int, ext string, format string, is_image boolean"
PII_SCHEMA = "ordinal int, key string, entity string, label string, tag string, default boolean"
PLATFORM_SCHEMA = "ordinal int, key string, label string, chars_per_token double, context_window long"

SUPPORTED_LIST = ", ".join(ext for ext, _ in FORMATS)
UNSUPPORTED_MESSAGE = f"Format not supported. Supported formats: {SUPPORTED_LIST}"
TOO_LARGE_MESSAGE = f"File too large (max {MAX_FILE_SIZE // (1024 * 1024)} MB)"
TOO_MANY_MESSAGE = f"Too many files (max {MAX_FILES_PER_BATCH})"
EMPTY_MESSAGE = "No files provided"
BATCH_TOO_LARGE_MESSAGE = "Request body too large"
EXTRACTOR_MESSAGE = "Extractor not available for this format"
ANONYMIZER_MESSAGE = "Anonymizer not available for: "


def format_catalog(spark: SparkSession) -> DataFrame:
    """S3: the 25-row extension -> format dimension, in declared order."""
    rows = [(i, ext, fmt, ext in IMAGE_EXTENSIONS) for i, (ext, fmt) in enumerate(FORMATS)]
    return spark.createDataFrame(rows, FORMAT_SCHEMA)


def format_families(catalog: DataFrame) -> DataFrame:
    """One row per format label with its first extension and extension count."""
    return catalog.groupBy("format").agg(
        F.min("ordinal").alias("ordinal"),
        F.min_by("ext", "ordinal").alias("first_ext"),
        F.count(F.lit(1)).alias("n_extensions"),
    )


def pii_catalog(spark: SparkSession) -> DataFrame:
    """The 12 PII entity types (10 on by default)."""
    rows = [(i, *e) for i, e in enumerate(PII_ENTITIES)]
    return spark.createDataFrame(rows, PII_SCHEMA)


def platform_catalog(spark: SparkSession) -> DataFrame:
    """The 4 token platforms."""
    rows = [(i, *p) for i, p in enumerate(PLATFORMS)]
    return spark.createDataFrame(rows, PLATFORM_SCHEMA)


def default_entity_keys() -> list[str]:
    """The keys that are on by default."""
    return [key for key, _, _, _, default in PII_ENTITIES if default]


def entity_tag(key: str) -> str:
    return {k: tag for k, _, _, tag, _ in PII_ENTITIES}[key]


def entity_type(key: str) -> str:
    return {k: ent for k, ent, _, _, _ in PII_ENTITIES}[key]
