"""PII operators over tables: detection, overlap resolution, redaction of any
text column, per-entity summaries, requested-entity resolution.

Spans are computed inside each row (native array expressions), so detection
and resolution never shuffle; only the summaries aggregate, with map-side
partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprep.functions import pii as P
from docprep.functions.models import missing_sources, redact_with_models
from docprep.sources import catalogs as C
from docprep.sources.catalogs import PII_ENTITIES, default_entity_keys


def detect_pii(df: DataFrame, text_col: str, keys: list[str] | None = None, id_cols: tuple[str, ...] = ("doc_id",), resolve: bool = False) -> DataFrame:
    """R2 (and R3 when ``resolve``): one row per span
    ``(*id_cols, entity, start, end, score, matched)``, code-point offsets, half-open."""
    keys = default_entity_keys() if keys is None else keys
    spans = P.detect_spans(F.col(text_col), keys)
    if resolve:
        spans = P.resolve_overlaps(spans)
    return df.select(*id_cols, F.explode(spans).alias("s")).select(*id_cols, "s.*")


def redact_resolved(text: Column, keys: list[str] | None = None) -> Column:
    """R3 + R4: redact with one replacement per stretch of text (overlaps resolved)."""
    keys = default_entity_keys() if keys is None else keys
    return P.redact_spans(text, P.resolve_overlaps(P.detect_spans(text, keys)))


def redact_columns(df: DataFrame, cols: list[str], keys: list[str] | None, anonymize: bool = True, models: dict | None = None) -> DataFrame:
    """Redact the requested entity types in each column; adds ``anonymized``
    (true when anonymisation was asked with a non-empty key list, even if every
    key is unknown). Types of the catalogue that neither a pattern nor one of ``models`` finds
    are an error: their values would stay in the text."""
    keys, models = list(keys or []), models or {}
    out = df
    if anonymize:
        if missing := missing_sources(keys, models):
            raise ValueError(C.ANONYMIZER_MESSAGE + ", ".join(missing))
        if any(k in models for k in keys):
            out = out.withColumns({c: redact_with_models(F.col(c), keys, models) for c in cols})
        elif P.known_keys(keys):
            out = out.withColumns({c: P.redact(F.col(c), keys) for c in cols})
    return out.withColumn("anonymized", F.lit(bool(anonymize and keys)))


def pii_summary(spans: DataFrame, group_cols: tuple[str, ...] = (), id_col: str = "doc_id") -> DataFrame:
    """A4: spans and documents per entity (and group)."""
    return spans.groupBy(*group_cols, "entity").agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.countDistinct(id_col).alias("n_docs"),
    )


def pii_counts(df: DataFrame, text_col: str, keys: list[str] | None = None, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """A4 straight from texts, a document being a row: the spans of a row are counted by entity inside the row,
    so two plain sums are left and no (entity, document) pair is shuffled."""
    keys = default_entity_keys() if keys is None else keys
    found = F.transform(P.detect_spans(F.col(text_col), keys), lambda s: s["entity"])
    counts = P.let(
        found,
        lambda a: F.transform(
            F.array_distinct(a), lambda e: F.struct(e.alias("entity"), F.size(F.filter(a, lambda x: x == e)).cast("long").alias("n"))
        ),
    )
    rows = df.select(*group_cols, F.explode(counts).alias("c")).select(*group_cols, "c.*")
    return rows.groupBy(*group_cols, "entity").agg(F.sum("n").alias("n_spans"), F.count(F.lit(1)).alias("n_docs"))


# --------------------------------------------------------------------------- entity parameters

_KEYS = [k for k, *_ in PII_ENTITIES]
_TAGS = [t for _, _, _, t, _ in PII_ENTITIES]
_DEFAULTS = default_entity_keys()


def parse_entities(raw: Column) -> Column:
    """P7: 'email,person, dni_nie' -> ['email', 'person', 'dni_nie']; NULL -> []."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), ",", -1), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def known_entities(keys: Column) -> Column:
    """Unknown keys dropped, request order kept, duplicates dropped."""
    known = F.array(*[F.lit(k) for k in _KEYS])
    return F.array_distinct(F.filter(keys, lambda k: F.array_contains(known, k)))


def entity_tags(keys: Column) -> Column:
    """Requested keys -> replacement tags (a plan-time lookup of the 12-row catalogue)."""
    lookup = F.create_map(*[x for k, t in zip(_KEYS, _TAGS) for x in (F.lit(k), F.lit(t))])
    return F.transform(keys, lambda k: F.element_at(lookup, k))


def default_entities() -> Column:
    """The keys that are on by default, as an array literal."""
    return F.array(*[F.lit(k) for k in _DEFAULTS])
