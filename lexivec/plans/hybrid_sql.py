"""DuckDB oracle texts for the hybrid retrieval queries (documents index, benchmark queries).

The same rules as ``operators.hybrid`` written as one CTE chain: row text, chunks, feature-
hashing embeddings (sparse, by bucket), exact top-20, LIKE hits, the ordered snippet fold,
blended rank, enrichment, context lines and prompts.
"""

from __future__ import annotations

from lexivec.config import CONTEXT_HEADER, ESSENTIAL_TERMS
from lexivec.plans import duck as D

TOP_ENRICH, CTX = 5, 5
INDEXED_AT = 1_700_000_000
SPLIT = r"'[^\p{L}\p{N}]+'"


def _embed(src: str, key: str, text: str) -> str:
    """Sparse unit vectors (key, b, v) of the hashing embedder, values rounded to FLOAT."""
    return f"""
SELECT {key}, b, ((cnt::DOUBLE / (sqrt(sum(cnt * cnt) OVER (PARTITION BY {key})) + 1e-12))::FLOAT)::DOUBLE AS v
FROM (
  SELECT {key}, code % 64 AS b, sum(CASE WHEN (code // 64) % 2 = 0 THEN 1 ELSE -1 END) AS cnt
  FROM (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT AS code
        FROM (SELECT {key}, unnest(list_filter(regexp_split_to_array(lower({text}), {SPLIT}), lambda t: length(t) >= 2)) AS t
              FROM {src}))
  GROUP BY {key}, b)"""


def _ctx_m() -> str:
    """Essential-term widening, one nested SELECT per term (order matters)."""
    inner = "SELECT *, least(length(raw), 220) AS m0 FROM ctx0 WHERE raw <> ''"
    for i, t in enumerate(ESSENTIAL_TERMS):
        idx = f"(strpos(lower(raw), '{t}') - 1)"
        inner = (
            f"SELECT *, CASE WHEN {idx} >= 0 AND {idx} + {len(t)} > m{i} "
            f"THEN least(greatest({idx} + {len(t)} + 40, m{i}), least(length(raw), 440)) ELSE m{i} END AS m{i + 1} "
            f"FROM ({inner})"
        )
    return inner


_TERMS = "[" + ", ".join(f"'{t}'" for t in ESSENTIAL_TERMS) + "]"
_N = len(ESSENTIAL_TERMS)
_HEADER = CONTEXT_HEADER.replace("\n", "' || chr(10) || '")

_SNIPPET = "substr(array_to_string(list_filter([d.text, d.lang, d.source], lambda v: v IS NOT NULL AND v <> ''), ' | '), 1, 500)"

LIKE_LEX = f"""
lex0 AS (
  SELECT q.query_id, 'documents' AS "table", d.doc_id::VARCHAR AS pk, {_SNIPPET} AS snippet, 0.0::DOUBLE AS score_ft
  FROM documents d JOIN q ON lower(d.text) LIKE '%' || lower(substr(q.text, 1, 64)) || '%'),"""


def _words(x: str) -> str:
    return f"coalesce(list_filter(regexp_split_to_array(lower({x}), {SPLIT}), lambda t: length(t) >= 1), [])"


# Plain queries of the boolean grammar: every word is optional, one of several tokens needs all of them.
FULLTEXT_LEX = f"""
fd AS (SELECT doc_id::VARCHAR AS pk, {_words('text')} || {_words('lang')} || {_words('source')} AS toks FROM documents),
fst AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM fd),
fpost AS (SELECT pk, t AS term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT pk, len(toks) AS dl, unnest(toks) AS t FROM fd) GROUP BY pk, t),
fdf AS (SELECT term, count(*) AS df FROM fpost GROUP BY term),
fw AS (SELECT pk, term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * (1.2 + 1.0) / (tf + 1.2 * (1.0 - 0.75 + 0.75 * dl / avgdl)) AS w
       FROM fpost JOIN fdf USING (term), fst),
fc AS (SELECT query_id, cno, unnest(list_distinct(ct)) AS term, len(list_distinct(ct)) AS n
       FROM (SELECT query_id, cno, {_words('word')} AS ct
             FROM (SELECT query_id, unnest(words) AS word, generate_subscripts(words, 1) AS cno
                   FROM (SELECT query_id, regexp_split_to_array(text, '\\s+') AS words FROM q)))),
fhit AS (SELECT query_id, cno, pk FROM fc JOIN fpost USING (term) GROUP BY query_id, cno, pk HAVING count(*) = any_value(n)),
fterm AS (SELECT DISTINCT h.query_id, h.pk, fc.term FROM fhit h JOIN fc USING (query_id, cno)),
fsc AS (SELECT query_id, pk, sum(w) AS score_ft FROM fterm JOIN fw USING (pk, term) GROUP BY query_id, pk),
lex0 AS (
  SELECT f.query_id, 'documents' AS "table", f.pk, {_SNIPPET} AS snippet, f.score_ft FROM fsc f JOIN documents d ON d.doc_id::VARCHAR = f.pk),"""


def base(K_VEC: int = 20, K_FT: int = 50, lexical: str = LIKE_LEX) -> str:
    """The CTE chain for given candidate counts (final cut max(k_vec, 10)) and a lexical mode."""
    FINAL_K = max(K_VEC, 10)
    return f"""
WITH docs AS ({D.row_docs_cte('documents', 'doc_id', ['text', 'lang', 'source'])}),
chunks AS (
  SELECT 'documents::' || pk || '::' || chunk_idx AS id, "table", pk, chunk_idx, chunk
  FROM ({D.chunks_of('docs')})),
cv AS ({_embed('chunks', 'id', 'chunk')}),
q AS (SELECT item_id AS query_id, text FROM benchmark),
qf AS ({_embed("(SELECT query_id, " + D.strip('text') + " AS k FROM q WHERE " + D.strip('text') + " <> '')", 'query_id', 'k')}),
qv AS (SELECT query_id, b, v / (sqrt(sum(v * v) OVER (PARTITION BY query_id)) + 1e-12) AS v FROM qf),
sc AS (SELECT qv.query_id, cv.id, round(sum(qv.v * cv.v), 6) AS score FROM qv JOIN cv USING (b) GROUP BY qv.query_id, cv.id),
sem AS (
  SELECT * FROM (SELECT query_id, id, score AS score_sem,
                        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS sem_rank FROM sc)
  WHERE sem_rank <= {K_VEC}),
semm AS (SELECT s.*, c."table", c.pk, c.chunk FROM sem s JOIN chunks c USING (id)),{lexical}
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, "table" ORDER BY round(score_ft, 6) DESC, pk) AS lex_rank FROM lex0)
        WHERE lex_rank <= {K_FT}),
sagg AS (SELECT query_id, "table", pk, list({{'r': sem_rank, 's': score_sem, 'c': chunk}} ORDER BY sem_rank) AS chunks
         FROM semm GROUP BY query_id, "table", pk),
j AS (
  SELECT coalesce(l.query_id, s.query_id) AS query_id, coalesce(l."table", s."table") AS "table", coalesce(l.pk, s.pk) AS pk,
         l.snippet AS lsnip, l.lex_rank, coalesce(l.score_ft, 0.0) AS score_ft, coalesce(s.chunks, []) AS chunks
  FROM lex l FULL OUTER JOIN sagg s ON l.query_id = s.query_id AND l."table" = s."table" AND l.pk = s.pk),
merged AS (
  SELECT query_id, "table", pk,
         list_reduce(
           list_transform(CASE WHEN lex_rank IS NOT NULL THEN chunks ELSE chunks[2:] END, lambda c: substr(c.c, 1, 250)),
           lambda acc, x: CASE WHEN x <> '' AND NOT contains(acc, x) THEN substr(acc || ' | ' || x, 1, 500) ELSE acc END,
           CASE WHEN lex_rank IS NOT NULL THEN coalesce(substr(lsnip, 1, 500), '') ELSE substr(chunks[1].c, 1, 250) END
         ) AS snippet,
         score_ft,
         CASE WHEN lex_rank IS NOT NULL
              THEN greatest(0.0, coalesce(list_max(list_transform(chunks, lambda c: c.s)), 0.0))
              ELSE list_max(list_transform(chunks, lambda c: c.s)) END AS score_sem,
         (list_filter(chunks, lambda c: c.c <> ''))[1].c AS combined_text,
         NULL::VARCHAR AS status,
         CASE WHEN len(chunks) > 0 THEN {INDEXED_AT}::BIGINT END AS indexed_at,
         lex_rank IS NULL AS sem_only, lex_rank, chunks[1].r AS first_sem_rank
  FROM j),
ranked AS (
  SELECT * FROM (
    SELECT *, round(0.6 * score_sem + 0.4 * score_ft, 6) AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY round(0.6 * score_sem + 0.4 * score_ft, 6) DESC,
                              sem_only, CASE WHEN NOT sem_only THEN "table" END NULLS FIRST,
                              lex_rank NULLS FIRST, first_sem_rank NULLS FIRST) AS rnk
    FROM merged) WHERE rnk <= {FINAL_K}),
en AS (
  SELECT doc_id::VARCHAR AS pk,
         array_to_string(list_filter([{', '.join(
             f"CASE WHEN {D.strip(c + '::VARCHAR')} <> '' THEN '{c}: ' || {D.strip(c + '::VARCHAR')} END"
             for c in ['doc_id', 'text', 'lang', 'source', 'n_chars'])}], lambda p: p IS NOT NULL), ' | ') AS enriched_full
  FROM documents WHERE doc_id::VARCHAR IN (SELECT pk FROM ranked WHERE rnk <= {TOP_ENRICH})),
enriched AS (
  SELECT r.* EXCLUDE (snippet),
         CASE WHEN r.rnk <= {TOP_ENRICH} AND e.enriched_full <> ''
                   AND len(list_filter({_TERMS}, lambda t: contains(lower(e.enriched_full), t) AND NOT contains(lower(r.snippet), t))) > 0
              THEN substr(e.enriched_full, 1, 500) ELSE r.snippet END AS snippet,
         CASE WHEN r.rnk <= {TOP_ENRICH} AND e.enriched_full <> '' THEN substr(e.enriched_full, 1, 600) END AS enriched
  FROM ranked r LEFT JOIN en e ON r."table" = 'documents' AND r.pk = e.pk),
ctx0 AS (
  SELECT query_id, rnk, "table", pk, status, indexed_at,
         {D.strip("replace(coalesce(nullif(enriched, ''), nullif(combined_text, ''), nullif(snippet, ''), ''), chr(10), ' ')")} AS raw
  FROM enriched WHERE rnk <= {CTX}),
ctx AS (
  SELECT query_id, rnk,
         '- ' || substr(raw, 1, m{_N}) || ' [' ||
         array_to_string(list_filter(['table=' || "table", 'pk=' || pk,
                                      CASE WHEN status <> '' THEN 'status=' || status END,
                                      CASE WHEN indexed_at <> 0 THEN 'indexed_at=' || indexed_at::VARCHAR END],
                                     lambda b: b IS NOT NULL), ', ') || ']' AS line
  FROM ({_ctx_m()}))
"""


BASE = base()

MERGE_SQL = BASE + """
SELECT query_id, "table", pk, snippet, round(score_ft, 6) AS score_ft, round(score_sem, 6) AS score_sem, combined_text, sem_only
FROM merged"""

RANK_SQL = BASE + """
SELECT rnk, query_id, "table", pk, score, round(score_sem, 6) AS score_sem FROM ranked"""

ENRICHED_SQL = BASE + f"""
SELECT query_id, rnk, pk, snippet, enriched FROM enriched WHERE rnk <= {TOP_ENRICH}"""

FULLTEXT_RANK_SQL = base(lexical=FULLTEXT_LEX) + """
SELECT rnk, query_id, "table", pk, round(score_ft, 6) AS score_ft, round(score_sem, 6) AS score_sem, snippet, sem_only FROM ranked"""

CONTEXT_SQL = BASE + """
SELECT query_id, rnk, line FROM ctx"""

PROMPT_SQL = BASE + f"""
SELECT q.query_id,
       CASE WHEN l.body IS NOT NULL THEN q.text || chr(10) || chr(10) || '{_HEADER}' || l.body ELSE q.text END AS prompt
FROM q LEFT JOIN (SELECT query_id, string_agg(line, chr(10) ORDER BY rnk) AS body FROM ctx GROUP BY query_id) l USING (query_id)"""

LIKE_SQL = BASE + """
SELECT query_id, "table", pk, snippet, lex_rank FROM lex"""

SEM_SQL = BASE + """
SELECT query_id, id, sem_rank, score_sem FROM sem"""
