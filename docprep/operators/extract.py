"""Text extraction: routing, fallback, per-format handlers.

Text-like formats are decoded natively (``decode(content, 'UTF-8')``) and
HTML and CSV go through native expressions. Formats that need a codec (PDF,
Office, images, audio) run a user-registered handler inside ``mapInPandas``:
the handler is built once per task, called per row, and a failure becomes an
error row instead of a failed job. Only those rows pass through Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docprep.functions.csv import csv_to_markdown
from docprep.functions.html import html_to_markdown
from docprep.functions.text import not_blank, strip_ws
from docprep.sources.catalogs import IMAGE_EXTENSIONS

# Formats whose bytes are already text.
TEXT_EXTENSIONS = (".txt", ".md", ".json", ".xml")
HTML_EXTENSIONS = (".html", ".htm")
CSV_EXTENSIONS = (".csv",)
NATIVE_EXTENSIONS = (*TEXT_EXTENSIONS, *HTML_EXTENSIONS, *CSV_EXTENSIONS)


def route(ext: Column) -> Column:
    """X1: 'ocr' for images, 'pdf' for PDF, else 'general' (case-insensitive)."""
    e = F.lower(ext)
    return F.when(e.isin(*IMAGE_EXTENSIONS), F.lit("ocr")).when(e == ".pdf", F.lit("pdf")).otherwise(F.lit("general"))


def with_fallback(primary: Column, fallback: Column) -> Column:
    """The primary text unless it failed (NULL) or is blank after strip."""
    return F.when(not_blank(primary), primary).otherwise(fallback)


def text_passthrough(content: Column) -> Column:
    """UTF-8 bytes -> text, unchanged; NULL for bytes that are not UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def trim_extracted(text: Column) -> Column:
    """OCR and PDF output is stripped at both ends."""
    return strip_ws(text)


def native_extract(ext: Column, text: Column) -> Column:
    """Extraction for formats that need no codec; NULL for the others."""
    e = F.lower(ext)
    return (
        F.when(e.isin(*TEXT_EXTENSIONS), text).when(e.isin(*HTML_EXTENSIONS), html_to_markdown(text)).when(e.isin(*CSV_EXTENSIONS), csv_to_markdown(text))
    )


# --------------------------------------------------------------------------- handlers (U4)


@dataclass
class Extractor:
    factory: Callable[..., Callable[[bytes], str]]
    fallback: Callable[..., Callable[[bytes], str]] | None = None
    options: dict = field(default_factory=dict)
    trim: bool = True


NO_TEXT = "the handler returned no text"
_EXTRACTORS: dict[str, Extractor] = {}


def register_extractor(key: str, factory, fallback=None, trim: bool = True, **options) -> None:
    """U4: ``factory(**options)`` returns ``handler(bytes) -> str``. ``key`` is an
    extension ('.pdf') or a route ('ocr', 'pdf', 'general'). Imports belong
    inside the factory so that a missing library only fails its own rows."""
    _EXTRACTORS[key.lower()] = Extractor(factory, fallback, options, trim)


def clear_extractors() -> None:
    _EXTRACTORS.clear()


def restore_extractors(saved: dict[str, Extractor]) -> None:
    """Registers what ``registered_extractors`` gave, and nothing else."""
    _EXTRACTORS.clear()
    _EXTRACTORS.update(saved)


def registered_extractors() -> dict[str, Extractor]:
    return dict(_EXTRACTORS)


def _runner(extractors: dict[str, Extractor]):
    route_of = {e: "ocr" for e in IMAGE_EXTENSIONS} | {".pdf": "pdf"}

    def as_text(x):
        if x is not None and not isinstance(x, str):
            raise TypeError(f"the handler returned {type(x).__name__}, not text")
        return x

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built: dict[str, tuple] = {}

        def handlers(ext: str):
            key = ext if ext in extractors else route_of.get(ext, "general")
            if key not in extractors:
                return None
            if key not in built:
                spec = extractors[key]
                try:
                    primary = spec.factory(**spec.options)
                    err = None
                except Exception as exc:  # noqa: BLE001 - engine missing or broken on this worker: its rows fail, no others
                    primary, err = None, exc
                fb = None
                if spec.fallback is not None:
                    try:
                        fb = spec.fallback(**spec.options)
                    except Exception:  # noqa: BLE001
                        fb = None
                built[key] = (primary, fb, err, spec.trim)
            return built[key]

        for pdf in batches:
            texts, codes, errors = [], [], []
            for ext, content in zip(pdf["ext"], pdf["content"]):
                h = handlers(ext or "")
                if h is None:
                    texts.append(None), codes.append("EXTRACTOR_UNAVAILABLE"), errors.append(f"No extractor for {ext or 'files without extension'}")
                    continue
                primary, fb, err, trim = h
                text, code, msg = None, None, None
                if primary is not None:
                    try:
                        text = as_text(primary(bytes(content) if content is not None else b""))
                        text = text.strip() if (trim and text is not None) else text
                    except (ImportError, OSError) as exc:
                        code, msg = "EXTRACTOR_UNAVAILABLE", str(exc)
                    except Exception as exc:  # noqa: BLE001 - a row's failure is data
                        code, msg = "FAILED", str(exc)
                else:
                    code, msg = "EXTRACTOR_UNAVAILABLE" if isinstance(err, (ImportError, OSError)) else "FAILED", str(err)
                if (text is None or not text.strip()) and fb is not None:
                    try:
                        text, code, msg = as_text(fb(bytes(content) if content is not None else b"")), None, None
                    except (ImportError, OSError) as exc:
                        text, code, msg = None, "EXTRACTOR_UNAVAILABLE", str(exc)
                    except Exception as exc:  # noqa: BLE001
                        text, code, msg = None, "FAILED", str(exc)
                if text is None and code is None:
                    code, msg = "FAILED", NO_TEXT
                texts.append(text if code is None else None), codes.append(code), errors.append(msg)
            yield pdf.assign(x_text=texts, x_code=codes, x_error=errors)

    return run


def apply_extractors(df: DataFrame, content_col: str = "content", ext_col: str = "ext") -> DataFrame:
    """Run the registered handlers on ``content``; adds ``x_text``, ``x_code``, ``x_error``.

    Meant for the rows that need a codec: callers route text-like rows to the
    native path first, so only codec rows cross into Python (Arrow batches).
    """
    extractors = registered_extractors()
    renamed = df.withColumnsRenamed({content_col: "content", ext_col: "ext"}) if (content_col, ext_col) != ("content", "ext") else df
    schema = T.StructType(
        list(renamed.schema.fields)
        + [T.StructField(n, T.StringType()) for n in ("x_text", "x_code", "x_error")]
    )
    out = renamed.mapInPandas(_runner(extractors), schema)
    if (content_col, ext_col) != ("content", "ext"):
        out = out.withColumnsRenamed({"content": content_col, "ext": ext_col})
    return out
