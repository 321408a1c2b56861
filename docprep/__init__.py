"""docprep: document preparation as Spark DataFrame operations.

Layout
------
- ``docprep.sources``    catalogues (formats, PII entities, token platforms), readers and sinks
- ``docprep.functions``  Column -> Column text kernels (names, compaction, PII, tokens, HTML)
- ``docprep.operators``  DataFrame -> DataFrame operators (admission, detection, reports, extraction)
- ``docprep.plans``      the end-to-end ``prepare`` pipeline and the registered queries
- ``docprep.streaming``  the same pipeline over Structured Streaming sources

Every text kernel is a native Catalyst expression (regex, higher-order array
functions, arithmetic); the core path has no Python UDF and no shuffle.
"""

from docprep.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
