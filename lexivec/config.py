"""One frozen configuration object, passed explicitly (no environment reads at import)."""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# These must equal the behaviour being reproduced.
# ---------------------------------------------------------------------------
# Terms that widen a context snippet / trigger the enriched-snippet swap, in this order.
ESSENTIAL_TERMS = ("time", "date", "place", "location", "venue", "address")
# Substrings of a lower-cased column name that mark an interval start / end.
START_MARKERS = ("start", "begin", "from")
END_MARKERS = ("end", "finish", "to", "until")
# Request-latency histogram upper bounds (seconds).
LATENCY_BUCKETS = (
    0.01, 0.025, 0.05, 0.075, 0.1,
    0.15, 0.25, 0.35, 0.5,
    0.75, 1.0, 1.5, 2.0,
    3.0, 5.0, 8.0, 13.0, 21.0, 34.0,
)
# Index-update job histogram upper bounds (seconds).
JOB_BUCKETS = (0.5, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144)
# Separators.
ROW_PART_SEP = " \n "
SNIPPET_SEP = " | "
ID_SEP = "::"
CONTEXT_HEADER = "\n\nContext (most relevant records with metadata):\n"


@dataclass(frozen=True)
class RetrievalConfig:
    # row text and chunking
    chunk_chars: int = 1200
    min_chunk_chars: int = 8
    combine_row_columns: bool = True
    include_column_names: bool = False
    always_include_patterns: tuple[str, ...] = ()
    fingerprint_include_patterns: tuple[str, ...] = ()
    index_row_limit: int | None = None  # None = whole table (the cap is opt-in)
    # retrieval
    k_vec: int = 20
    k_ft: int = 50
    fulltext_required: bool = False  # False: LIKE lexical search, True: boolean full-text search
    like_chars: int | None = 64  # None = the whole query
    lex_snippet_chars: int = 500
    sem_snippet_chars: int = 250
    lex_text_columns: int = 4
    fulltext_columns: int = 3
    w_sem: float = 0.6
    w_ft: float = 0.4
    # BM25
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    min_token_len: int = 2
    # enrichment and context
    row_enrich: bool = True
    row_enrich_chars: int = 600
    enrich_top: int = 5
    enrich_max_columns: int = 50
    essential_terms: tuple[str, ...] = ESSENTIAL_TERMS
    context_snippets: int = 5
    context_chars: int = 220
    # status
    status_timezone: str = "UTC"
    # maintenance
    delete_missing: bool = False
    # embedding
    embed_dim: int = 64
    # physical knobs
    broadcast_max_bytes: int = 64 * 1024 * 1024  # largest side we ever ship to every task
    query_batch_rows: int = 4096  # query vectors per broadcast block in exact top-k

    def with_(self, **kw) -> "RetrievalConfig":
        return replace(self, **kw)

    @property
    def final_k(self) -> int:
        return max(self.k_vec, 10)


DEFAULT = RetrievalConfig()
