"""The registered queries of the corpus operators: thin readers of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.llm.common import table
from lexivec.session import scratch_path


def tokenizer_path(name: str) -> str:
    """A public tokenizer file on the driver; executors get its content by broadcast."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexivec.llm.language_id import language_of_documents

    return language_of_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexivec.llm.line_dedup import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = dedup_lines(docs, min_docs=10, min_chars=1)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexivec.llm.simhash_golay import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), size=3, most=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Entries of the block lists come from the pages' own hosts: the first 24 bits of a name's MD5
#: say whether and when (days after the start) it was put on a list, taken off, and put on again.
LIST_START = "2024-01-01 00:00:00"


def list_events(pages: DataFrame) -> DataFrame:
    from lexivec.llm.url_filters import host_of, path_of

    named = pages.select(host_of(F.col("url")).alias("host"), F.split(path_of(F.col("url")), "/")[1].alias("segment")).where("host is not null").distinct()
    hosts = named.select("host").distinct()
    below = F.expr("substring(host, instr(host, '.') + 1)")
    parents = hosts.where(F.size(F.split("host", r"\.")) > 3).select(below.alias("pattern")).distinct()
    prefixes = named.where("segment is not null and segment != ''").select(F.concat_ws("/", "host", "segment").alias("pattern")).distinct()
    parts = []
    for kind, patterns, keep, days in (
        ("host", hosts.select(F.col("host").alias("pattern")), "v % 3 = 0", (("add", "v % 150"), ("remove", "v % 150 + 60"), ("add", "v % 150 + 120"))),
        ("domain", parents, "v % 4 = 1", (("add", "v % 300"),)),
        ("prefix", prefixes, "v % 5 = 2", (("add", "v % 200"), ("remove", "v % 200 + 100"))),
    ):
        rows = patterns.withColumn("v", F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("int")).where(keep)
        for action, day in days:
            at = F.expr(f"timestamp '{LIST_START}' + make_interval(0, 0, 0, {day})")
            parts.append(rows.select(F.lit("blocklist").alias("list"), F.lit(kind).alias("kind"), "pattern", F.lit(action).alias("action"), at.alias("at")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` has no fetch times: a page's is taken from its id, spread over a year."""
    from lexivec.llm.url_filters import judge

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    seconds = F.pmod(F.col("page_id") * 7919, F.lit(31_536_000)).cast("int")
    captures = pages.withColumn("fetched_at", F.expr(f"timestamp '{LIST_START}'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")))
    return judge(captures, list_events(pages)).select("page_id", "url", "fetched_at", "host", "n_active", "blocked", "entry")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexivec.llm.pii import KINDS, find_personal_data, spans_text

    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {n})) as bigint)").alias(f"n_{kind}") for n, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache in the shared folder."""
    from lexivec.llm.bpe import read_spec
    from lexivec.llm.token_counts import count_tokens

    docs = table(spark, sf_dir, "documents")
    counted = count_tokens(docs, read_spec(tokenizer_path("byte_bpe_50k.json")), scratch_path(spark, "token-cache"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexivec.llm.bpe import read_spec, round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), read_spec(tokenizer_path("byte_bpe_50k.json")))


def op8_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexivec.llm.ann_tree import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document has one source here, so every pattern has one."""
    from lexivec.llm.mixing import mix

    chosen, quotas, _ = mix(table(spark, sf_dir, "documents"), F.array("source"), weights=(5, 2, 1), share=1.5, most=2)
    chosen = chosen.withColumn("source", F.from_json("pattern", "array<string>")[0])
    rows = chosen.join(F.broadcast(quotas), chosen.source.eqNullSafe(quotas.source))
    rows = rows.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexivec.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexivec.llm.bpe import read_spec
    from lexivec.llm.tokenizer_alignment import alignment_of_documents

    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return alignment_of_documents(table(spark, sf_dir, "documents"), read_spec(tokenizer_path("byte_bpe_50k.json")), model)


def op12_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexivec.llm.quality_crf import quality_of_documents

    return quality_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexivec.llm.conversation_repair import damaged_and_repaired

    return damaged_and_repaired(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_simhash_golay": op3_simhash_golay,
    "op4_url_filters": op4_url_filters,
    "op5_pii": op5_pii,
    "op6_token_counts": op6_token_counts,
    "op7_bpe": op7_bpe,
    "op8_ann_tree": op8_ann_tree,
    "op9_mixing": op9_mixing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_quality_crf": op12_quality_crf,
    "op13_conversation_repair": op13_conversation_repair,
}

_HOST = r"rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)', 1)), '.')"
_PATH = _HOST.replace("rtrim(lower(", "").replace(", 1)), '.')", ", 2)")
_START = f"TIMESTAMP '{LIST_START}'"

ORACLES: dict[str, str] = {
    "op4_url_filters": f"""
        WITH captures AS (
            SELECT page_id, url, {_START} + to_seconds((page_id * 7919) % 31536000) AS fetched_at, nullif({_HOST}, '') AS host, {_PATH} AS path FROM pages
        ), named AS (SELECT DISTINCT host, string_split(path, '/')[2] AS segment FROM captures WHERE host IS NOT NULL),
        patterns AS (
            SELECT DISTINCT 'host' AS kind, host AS pattern FROM named
            UNION ALL SELECT DISTINCT 'domain', substr(host, strpos(host, '.') + 1) FROM named WHERE len(string_split(host, '.')) > 3
            UNION ALL SELECT DISTINCT 'prefix', host || '/' || segment FROM named WHERE segment <> ''
        ), v AS (SELECT kind, pattern, ('0x' || substr(md5(pattern), 1, 6))::INT AS v FROM patterns),
        intervals AS (
            SELECT kind, pattern, v % 150 AS since, v % 150 + 60 AS until FROM v WHERE kind = 'host' AND v % 3 = 0
            UNION ALL SELECT kind, pattern, v % 150 + 120, NULL FROM v WHERE kind = 'host' AND v % 3 = 0
            UNION ALL SELECT kind, pattern, v % 300, NULL FROM v WHERE kind = 'domain' AND v % 4 = 1
            UNION ALL SELECT kind, pattern, v % 200, v % 200 + 100 FROM v WHERE kind = 'prefix' AND v % 5 = 2
        ), active AS (
            SELECT c.page_id, i.kind, i.pattern FROM captures c JOIN intervals i
            ON c.fetched_at >= {_START} + to_days(i.since::INT) AND (i.until IS NULL OR c.fetched_at < {_START} + to_days(i.until::INT))
            AND CASE i.kind WHEN 'host' THEN c.host = i.pattern WHEN 'domain' THEN c.host = i.pattern OR ends_with(c.host, '.' || i.pattern)
                ELSE c.host || c.path = i.pattern OR starts_with(c.host || c.path, i.pattern || '/') END
        ), best AS (
            SELECT page_id, count(*) AS n, first('blocklist:' || kind || ':' || pattern ORDER BY length(pattern) DESC, kind, pattern) AS entry FROM active GROUP BY page_id
        )
        SELECT c.page_id, c.url, c.fetched_at, c.host, coalesce(b.n, 0) AS n_active, b.n IS NOT NULL AS blocked, b.entry FROM captures c LEFT JOIN best b ON c.page_id = b.page_id
    """,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op2_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, i, line,
                   translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
        ), common AS (
            SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        )
        SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
        FROM lines l LEFT JOIN common c ON l.key = c.key GROUP BY doc_id
    """,
}
