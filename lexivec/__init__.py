"""lexivec: hybrid (lexical + vector) retrieval over tables, written as Spark DataFrame plans.

Layout
------
- ``sources``   table registry, catalog, row-document scans, index table load/save
- ``functions`` column expressions (text, fingerprints, chunks, vectors, timestamps)
- ``operators`` chunking, embedding, vector top-k, lexical search, hybrid merge, context,
                incremental index maintenance, reports
- ``plans``     guarded SQL and the query catalogue used by ``__spark_entry__``
- ``streaming`` Structured Streaming jobs and keyed stateful operators
"""

from lexivec.config import RetrievalConfig

__all__ = ["RetrievalConfig"]
