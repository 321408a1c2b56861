"""Free-text entity recognition: gazetteers (D12) and pluggable models.

* A gazetteer is a table of terms of one or more words; documents are tokenised
  as arrays of code points inside the tasks (``wordruns``), a run of tokens grows only
  while a Bloom filter of the terms' prefixes holds it, and the runs left (one row each,
  with offsets) are joined with the terms on the lower-cased words, natively.
  The gazetteer is broadcast only when its rows and bytes are within checked bounds,
  otherwise the join shuffles on the lower-cased words.
* A model is user code behind ``register_model``: an iterator Pandas UDF builds
  it once per task (``factory()``) and maps Arrow batches of texts to span
  arrays. The statistical model itself is not part of this library.
* ``gazetteer_model`` makes a model from a gazetteer of bounded size, so that
  redaction and the pipeline can use either kind as a source of spans.
"""

from __future__ import annotations

import re
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docprep.functions.pii import SPAN_TYPE, detect_spans, entity_type, known_keys, redact_spans, resolve_overlaps
from docprep.functions.text import cut, let, text_chunks
from docprep.functions.wordruns import WordKit, probes, word_codes
from docprep.sources.catalogs import PII_ENTITIES

TOKEN_RX = "[\\p{L}\\p{N}]+"
TOKEN_GAP_RX = "[^\\p{L}\\p{N}]"
MODEL_SPAN_TYPE = "array<struct<start:int,end:int,score:double>>"
# Largest gazetteer that is broadcast (distinct terms and their total UTF-8
# bytes); beyond either bound the join shuffles on the lower-cased token.
MAX_BROADCAST_TERMS = 2_000_000
MAX_BROADCAST_TERM_BYTES = 64 * 1024 * 1024
# Largest filter of term prefixes that a plan carries (256 KB).
MAX_FILTER_BITS = 1 << 21

_ENTITY = {key: (entity, tag) for key, entity, _, tag, _ in PII_ENTITIES}
_MODELS: dict[str, Callable[[], Callable[[str], list[tuple[int, int, float]]]]] = {}


def gazetteer_spans(
    df: DataFrame,
    text_col: str,
    gazetteer: DataFrame,
    term_col: str = "term",
    entity_key: str = "location",
    id_cols: tuple[str, ...] = ("doc_id",),
    max_broadcast_terms: int = MAX_BROADCAST_TERMS,
    max_broadcast_bytes: int = MAX_BROADCAST_TERM_BYTES,
) -> DataFrame:
    """Spans of the gazetteer's terms, in any case.

    A term is the words (letters and digits) of its text, whatever stands between them; in a
    document its words must follow each other with exactly one other character between two
    ("New York", "Saint-Denis"). Terms without a word match nothing. Overlapping matches are all given.
    """
    terms = _terms(gazetteer, term_col)
    # the size check behind the broadcast decision (rows, bytes), the longest term and the number of prefixes, one job
    size = terms.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("__key")), F.lit(0)).alias("b"), F.max("__n").alias("longest"), F.sum("__n").alias("p")
    ).first()
    filter_words = _prefix_filter(terms, size["p"] or 0)
    terms = terms.select("__key")
    if size["n"] <= max_broadcast_terms and size["b"] <= max_broadcast_bytes:
        terms = F.broadcast(terms)
    runs = _term_runs(df.select(*id_cols, F.col(text_col).alias("__text")), filter_words, size["longest"] or 1)
    words = F.when(F.col("__n") == 1, F.col("matched")).otherwise(F.regexp_replace("matched", TOKEN_GAP_RX, " "))
    found = runs.withColumns({"__key": F.lower(words), "entity": F.lit(entity_type(entity_key)), "score": F.lit(0.85)})
    return found.join(terms, "__key", "left_semi").select(*id_cols, "entity", "start", "end", "score", "matched")


def _terms(gazetteer: DataFrame, term_col: str) -> DataFrame:
    """Distinct lower-cased terms: ``__key`` (words joined by blanks), ``__n`` (number of words) and ``__words`` (joined as they are written)."""
    words = F.regexp_extract_all(F.col(term_col), F.lit(TOKEN_RX), 0)
    lower = F.transform(words, F.lower)
    keyed = gazetteer.select(F.array_join(lower, " ").alias("__key"), F.size(words).alias("__n"), F.array_join(words, " ").alias("__words"))
    return keyed.filter("__n > 0").groupBy("__key", "__n").agg(F.min("__words").alias("__words"))


def _prefix_filter(terms: DataFrame, n_prefixes: int) -> list[int]:
    """Bloom filter, in words of 64 bits, of the terms and of their prefixes of one or more words.

    It has about 16 bits an entry and at most ``MAX_FILTER_BITS``, so what reaches the driver is
    bounded; a filter that is too full lets more runs through to the join, and loses none.
    """
    bits = 1024
    while bits < min(32 * n_prefixes, MAX_FILTER_BITS):
        bits *= 2
    codes = word_codes(terms.sparkSession, TOKEN_RX)

    def places(batches):
        kit = WordKit(codes)
        for b in batches:
            for words, _, at, _, _ in kit.chunks(b.column(0).to_pylist()):
                piece = np.searchsorted(at, words.begin, "right") - 1
                last = np.arange(len(piece))
                first, whole = np.searchsorted(piece, piece), np.append(piece[1:] != piece[:-1], True)
                h = words.hashes(first, last)
                bit = np.unique(np.concatenate([*probes(h, False, bits), *probes(h[whole], True, bits)]))
                yield pa.RecordBatch.from_arrays([pa.array(bit.astype(np.int64))], ["at"])

    words_of = terms.select("__words").mapInArrow(places, "at long").groupBy(F.shiftright("at", 6).cast("int").alias("word"))
    out = [0] * (bits // 64)
    for r in words_of.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).collect():  # bits / 64 rows at most
        out[r["word"]] = r["set"]
    return out


def _term_runs(df: DataFrame, filter_words: list[int], longest: int) -> DataFrame:
    """Runs of words with single characters between them that pass the filter as terms, a row each: the columns of ``df``
    but the last, the text, then ``start``, ``end`` (code points), ``__n`` (words) and ``matched``.

    Step k makes each run that is still some term's prefix longer by its next word, so the work is the words and
    the prefixes met, and the plan is the same whatever the terms' lengths.
    """
    bits, codes = 64 * len(filter_words), word_codes(df.sparkSession, TOKEN_RX)
    filter_bytes = np.array(filter_words, "<i8").tobytes()

    def run(batches):
        kit = WordKit(codes)
        filter_bits = np.unpackbits(np.frombuffer(filter_bytes, np.uint8), bitorder="little").view(bool)
        for b in batches:
            *ids, texts = b.columns
            for words, joined, at, rows, starts in kit.chunks(texts.to_pylist()):
                first, n = words.runs(longest, bits, filter_bits)
                begin, end = words.begin[first], words.end[first + n - 1]
                piece = np.searchsorted(at, begin, "right") - 1
                shift, row = starts[piece] - at[piece], pa.array(rows[piece])
                matched = pa.array([joined[i:j] for i, j in zip(begin.tolist(), end.tolist())], pa.string())
                spans = [pa.array((x + shift).astype(np.int32)) for x in (begin, end)]
                yield pa.RecordBatch.from_arrays([*(c.take(row) for c in ids), *spans, pa.array(n), matched], names)

    spans = StructType().add("start", "integer").add("end", "integer").add("__n", "integer").add("matched", "string")
    schema = StructType([*df.schema.fields[:-1], *spans.fields])
    names = schema.names
    return df.mapInArrow(run, schema)


def gazetteer_model(gazetteer: DataFrame, term_col: str = "term", max_terms: int = MAX_BROADCAST_TERMS, score: float = 0.85):
    """A model factory from a gazetteer of at most ``max_terms`` distinct terms (checked, never cut):
    at every token the longest term that starts there, by the rules of ``gazetteer_spans``."""
    rows = _terms(gazetteer, term_col).limit(max_terms + 1).collect()
    if len(rows) > max_terms:
        raise ValueError(f"the gazetteer has more than {max_terms} terms; raise max_terms or use gazetteer_spans")
    keys = frozenset(r["__key"] for r in rows)
    prefixes = frozenset(" ".join(w[: k + 1]) for w in (key.split(" ") for key in keys) for k in range(len(w)))
    word = re.compile(r"[^\W_]+")

    def factory():
        def predict(text: str) -> list[tuple[int, int, float]]:
            at = [(m.start(), m.end(), m.group().lower()) for m in word.finditer(text)]
            out, i = [], 0
            while i < len(at):
                key, longest = at[i][2], 0
                for n in range(1, len(at) - i + 1):
                    if key in keys:
                        longest = n
                    if key not in prefixes or i + n == len(at) or at[i + n - 1][1] + 1 != at[i + n][0]:
                        break
                    key = f"{key} {at[i + n][2]}"
                if longest:
                    out.append((at[i][0], at[i + longest - 1][1], score))
                i += longest or 1
            return out

        return predict

    return factory


def register_model(entity_key: str, factory: Callable[[], Callable[[str], list[tuple[int, int, float]]]]) -> None:
    """``factory()`` returns ``predict(text) -> [(start, end, score), ...]``."""
    _MODELS[entity_key] = factory


def registered_models() -> dict[str, Callable]:
    return dict(_MODELS)


def missing_sources(keys: list[str], models: dict[str, Callable] | None = None) -> list[str]:
    """Requested entity types of the catalogue that neither a pattern nor a model can find."""
    have = set(known_keys(keys)) | set(models or {})
    return [k for k in dict.fromkeys(keys) if k in _ENTITY and k not in have]


def redact_with_models(text: Column, keys: list[str], models: dict[str, Callable]) -> Column:
    """R4 with spans of patterns and models together: overlaps resolved (R3), then replaced by the types' tags."""
    found = [detect_spans(text, keys)]
    for key in dict.fromkeys(k for k in keys if k in models):
        found.append(_typed_spans(text, model_spans(text, key, models[key]), _ENTITY.get(key, (key.upper(), ""))[0]))
    spans = resolve_overlaps(F.coalesce(F.concat(*found), F.array().cast(SPAN_TYPE)))
    tags = {entity: tag for entity, tag in _ENTITY.values()} | {k.upper(): f"[{k.upper()}]" for k in models if k not in _ENTITY}
    return F.when(text.isNotNull(), redact_spans(text, spans, tags))


def _typed_spans(text: Column, spans: Column, entity: str) -> Column:
    """Spans of a model with their type and their text, cut from the text's chunks inside the array."""
    fields = lambda s: (F.lit(entity).alias("entity"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))
    return let(
        F.struct(text_chunks(text).alias("c"), spans.alias("s")),
        lambda b: F.transform(b["s"], lambda s: F.struct(*fields(s), cut(b["c"], s["start"], s["end"]).alias("matched"))),
    )


def model_spans(text: Column, entity_key: str, factory: Callable | None = None) -> Column:
    """Spans predicted by ``factory``'s model, or the registered one (built once per task)."""
    factory = _MODELS[entity_key] if factory is None else factory

    @F.pandas_udf(MODEL_SPAN_TYPE)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            yield texts.map(
                lambda t: [] if t is None else [{"start": int(s), "end": int(e), "score": float(sc)} for s, e, sc in model(t)]
            )

    return predict(text)


def detect_with_model(df: DataFrame, text_col: str, entity_key: str, entity: str, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Long span table from a registered model; ``matched`` is cut natively
    from the text's chunks inside the span array, before the explode, so a
    long document with many spans is neither walked per span nor copied per row."""
    t = F.col(text_col)
    spans = model_spans(t, entity_key)
    with_text = _typed_spans(t, spans, entity)
    return df.select(*id_cols, F.explode(with_text).alias("s")).select(*id_cols, "s.*")
