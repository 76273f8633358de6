"""Boolean full-text search (J4): the query text is a small grammar, evaluated on an inverted index.

Grammar (whitespace-separated terms): ``word`` optional, ``+word`` required, ``-word`` excluded,
``word*`` prefix, ``"a b"`` phrase (may carry ``+``/``-``). A word is its tokens (same tokenizer
as BM25); a term matches a document when all its tokens are document tokens, the last one as a
prefix for ``word*``, and for a phrase when its tokens also occur consecutively. A document
matches when every required term matches, no excluded term does, and at least one non-excluded
term does. Score: BM25 over the distinct tokens of the matched non-excluded terms.

Queries that fit the broadcast budget are answered in two passes over the texts (``operators.fulltext_scan``).
Others, and queries that share an id, over the stored index (``sources.text_index``; nothing is tokenised in
a search):

* words are looked up in the vocabulary, prefixes are its terms with that beginning (joined on the
  first one or two characters); both bring their number of rows;
* a query's *driver* is its rarest required term: only rows in the driver's postings are looked at
  for any other term. Queries without a required term look at all their postings;
* one-token words and prefixes are counted and summed per (query, row) directly. All extensions of
  a prefix are summed once per (prefix, row), for every query that has the prefix. Which of them would
  count one token twice is known from the query alone and left out beforehand;
* terms of several tokens match when all their postings of a row are there; a phrase also needs a
  position p of its first token with its n-th token at p + n: the position lists are merged by a join
  on the phrase's start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.config import RetrievalConfig
from lexivec.functions.text import tokens
from lexivec.operators.fulltext import with_keys
from lexivec.operators.fulltext_scan import scan_scores
from lexivec.operators.lexical import lexical_hits, rank_per_table, with_snippets
from lexivec.operators.plan_utils import counted_broadcast
from lexivec.session import store_once
from lexivec.sources.tables import TableSpec
from lexivec.sources.text_index import TextIndex, text_columns, text_index

#: Every token counts here, also one-letter ones: a dropped required or excluded term would change
#: which rows match.
MIN_TOKEN = 1
TERM_PATTERN = r'([+-]?)("[^"]*"|[^\s"]+)'
PAIR = ["query_id", "did"]
CLAUSE = ["query_id", "term_no"]


def parse_boolean(queries: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """``(query_id, term_no, op, kind, toks, exact, prefix)``: ``toks`` in order (phrases),
    ``exact`` = distinct tokens that must match exactly, ``prefix`` = last token of ``word*``."""
    ops = F.regexp_extract_all(F.col("text"), F.lit(TERM_PATTERN), 1)
    bodies = F.regexp_extract_all(F.col("text"), F.lit(TERM_PATTERN), 2)
    t = queries.select("query_id", F.posexplode(F.arrays_zip(ops.alias("op"), bodies.alias("body"))).alias("term_no", "x"))
    body = F.col("x.body")
    is_phrase = body.startswith('"')
    is_prefix = ~is_phrase & body.endswith("*")
    clean = F.regexp_replace(body, r'^"|"$|\*$', "")
    toks = tokens(clean, MIN_TOKEN)
    n = F.size(toks)
    out = t.select(
        "query_id",
        "term_no",
        F.col("x.op").alias("op"),
        F.when(is_phrase & (n >= 2), "phrase").when(is_prefix, "prefix").otherwise("word").alias("kind"),
        toks.alias("toks"),
        F.array_distinct(F.when(is_prefix, F.slice(toks, 1, F.greatest(n - 1, F.lit(0)))).otherwise(toks)).alias("exact"),
        F.when(is_prefix & (n > 0), F.element_at(toks, -1)).alias("prefix"),
    )
    return out.where((F.size("exact") > 0) | F.col("prefix").isNotNull())


def prefix_terms(index: TextIndex, prefixes: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """``(prefix, term, df, idf)``: the vocabulary under each distinct prefix."""
    wanted = counted_broadcast(prefixes, 64, cfg)
    vocab = index.terms.select("term", "df", "idf", F.explode(F.array_distinct(F.array(F.substring("head", 1, 1), F.col("head")))).alias("start"))
    found = vocab.join(wanted.withColumn("start", F.substring("prefix", 1, 2)), "start").where(F.col("term").startswith(F.col("prefix")))
    return found.select("prefix", "term", "df", "idf")


def drivers(clauses: DataFrame, exact: DataFrame, extensions: DataFrame) -> DataFrame:
    """``(query_id, driver, by_prefix)`` for queries with a required term: the token, or the prefix,
    of their required terms with the fewest rows. A token that no row has is the rarest of all."""
    needed = clauses.where("op = '+'")
    words = needed.select(*CLAUSE, F.explode("exact").alias("driver")).join(
        exact.select("query_id", "term_no", F.col("term").alias("driver"), "df"), [*CLAUSE, "driver"], "left"
    )
    sizes = extensions.groupBy("prefix").agg(F.sum("df").alias("df"))
    starts = needed.where("prefix is not null").select(*CLAUSE, F.col("prefix").alias("driver")).join(
        sizes.withColumnRenamed("prefix", "driver"), "driver", "left"
    )
    both = words.select("query_id", "driver", F.lit(False).alias("by_prefix"), F.coalesce("df", F.lit(0)).alias("df")).unionByName(
        starts.select("query_id", "driver", F.lit(True).alias("by_prefix"), F.coalesce("df", F.lit(0)).alias("df"))
    )
    least = both.groupBy("query_id").agg(F.min(F.struct("df", "driver", "by_prefix")).alias("x"))
    return least.select("query_id", "x.driver", "x.by_prefix")


def once(simple: DataFrame, clauses: DataFrame) -> DataFrame:
    """``simple(query_id, term_no, op, token, is_prefix)`` with ``counts``: does the term add to the
    score? Excluded ones never do; a token is added by its first word, unless a prefix that adds
    already has it; a prefix is added unless a shorter (or an equal, earlier) one has it."""
    heads = clauses.where("prefix is not null and size(exact) = 0 and op != '-'").select(
        "query_id", F.col("term_no").alias("other_no"), F.col("prefix").alias("other")
    )
    covered = simple.join(heads, "query_id").where(
        F.col("token").startswith(F.col("other"))
        & (~F.col("is_prefix") | (F.length("other") < F.length("token")) | ((F.col("other") == F.col("token")) & (F.col("other_no") < F.col("term_no"))))
    )
    covered = covered.select(*CLAUSE).distinct().withColumn("covered", F.lit(True))
    first = simple.where("op != '-' and not is_prefix").groupBy("query_id", "token").agg(F.min("term_no").alias("first_no"))
    out = simple.join(covered, CLAUSE, "left").join(first, ["query_id", "token"], "left")
    counts = (F.col("op") != "-") & F.col("covered").isNull() & (F.col("is_prefix") | (F.col("term_no") == F.col("first_no")))
    return out.select(*CLAUSE, "op", "token", "is_prefix", counts.alias("counts"))


def phrase_rows(items: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(query_id, did, term_no)`` of the phrases that occur. ``items(query_id, did, term_no, term,
    pos)`` are the position lists, ``phrases(query_id, term_no, at, term, length)`` the n-th tokens.
    Each token votes for the starts it allows; a start with all votes is an occurrence."""
    votes = items.join(phrases, [*CLAUSE, "term"]).select(*PAIR, "term_no", "length", "at", F.explode("pos").alias("p"))
    votes = votes.withColumn("start", F.col("p") - F.col("at")).groupBy(*PAIR, "term_no", "length", "start").agg(F.count("*").alias("votes"))
    return votes.where(F.col("votes") == F.col("length")).select(*PAIR, "term_no").distinct()


def scored_rows(index: TextIndex, clauses: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """``(query_id, did, score_ft)`` of the rows that each query's grammar admits. ``clauses`` is
    ``parse_boolean``, stored."""

    def side(df: DataFrame) -> DataFrame:
        return counted_broadcast(df, 96, cfg)

    words = clauses.select(*CLAUSE, "op", F.explode("exact").alias("term"))
    exact = store_once(index.terms.join(side(words), "term").select(*CLAUSE, "op", "term", "df", "idf"), "query-words")
    extensions = store_once(prefix_terms(index, clauses.where("prefix is not null").select("prefix").distinct(), cfg), "extensions")
    post = index.postings.select("term", "did", "imp")

    # rows worth a look: the driver's, or all of a query without required terms
    rarest = store_once(drivers(clauses, exact, extensions), "drivers")
    by_word = post.join(side(rarest.where("not by_prefix").select("query_id", F.col("driver").alias("term"))), "term").select(*PAIR)
    starts = extensions.join(rarest.where("by_prefix").select("query_id", F.col("driver").alias("prefix")), "prefix").select("query_id", "term")
    looked_at = store_once(by_word.unionByName(post.join(side(starts), "term").select(*PAIR).distinct()), "driver-rows")
    driven = side(rarest.select("query_id"))
    rows = side(looked_at)

    def at_drivers(df: DataFrame) -> DataFrame:
        return df.join(driven, "query_id", "left_anti").unionByName(df.join(rows, PAIR, "left_semi"))

    # one-token words and prefixes
    one = clauses.where("kind != 'phrase' and (size(exact) = 1 and prefix is null or size(exact) = 0 and prefix is not null)")
    simple = one.select(*CLAUSE, "op", F.coalesce("prefix", F.col("exact")[0]).alias("token"), F.col("prefix").isNotNull().alias("is_prefix"))
    simple = store_once(once(simple, clauses), "query-terms")
    idf = exact.select("term", "idf").distinct()
    of_word = simple.where("not is_prefix").join(idf.withColumnRenamed("term", "token"), "token")
    word_hits = post.join(side(of_word.withColumnRenamed("token", "term")), "term").select(
        *PAIR, "op", F.when(F.col("counts"), F.col("idf") * F.col("imp")).otherwise(0.0).alias("w")
    )
    sums = post.join(side(extensions.select("prefix", "term", "idf")), "term").groupBy("prefix", "did").agg(F.sum(F.col("idf") * F.col("imp")).alias("w"))
    of_prefix = simple.where("is_prefix").withColumnRenamed("token", "prefix")
    prefix_hits = sums.join(side(of_prefix), "prefix").select(*PAIR, "op", F.when(F.col("counts"), F.col("w")).otherwise(0.0).alias("w"))

    # terms of several tokens
    many = clauses.where("kind = 'phrase' or size(exact) > 1 or size(exact) = 1 and prefix is not null")
    several = store_once(many.select(*CLAUSE, "op", "kind", "toks", "prefix", F.size("exact").alias("n_exact")), "long-terms")
    joined = exact.join(several.select(*CLAUSE, "n_exact"), CLAUSE)
    positions = index.postings.select("term", "did", "imp", "pos")
    items = store_once(at_drivers(positions.join(side(joined), "term").select(*PAIR, "term_no", "term", (F.col("idf") * F.col("imp")).alias("w"), "pos", "n_exact")), "long-term-rows")
    whole = items.groupBy(*PAIR, "term_no", "n_exact").agg(F.count("*").alias("n")).where("n = n_exact").select(*PAIR, "term_no")
    phrases = several.where("kind = 'phrase'").select(*CLAUSE, F.size("toks").alias("length"), F.posexplode("toks").alias("at", "term"))
    of_phrase = side(phrases.select(*CLAUSE).distinct())
    whole = whole.join(of_phrase, CLAUSE, "left_anti").unionByName(phrase_rows(items, phrases))
    # word* of several tokens: an extension of its last token must be there too
    half = several.where("prefix is not null")
    ends = at_drivers(
        post.join(side(half.select(*CLAUSE, "prefix").join(extensions, "prefix").select(*CLAUSE, "term", "idf")), "term")
        .select(*PAIR, "term_no", "term", (F.col("idf") * F.col("imp")).alias("w"))
    )
    of_half = side(half.select(*CLAUSE))
    whole = whole.join(of_half, CLAUSE, "left_anti").unionByName(
        whole.join(of_half, CLAUSE, "left_semi").join(ends.select(*PAIR, "term_no").distinct(), [*PAIR, "term_no"])
    )
    whole = store_once(whole.join(side(several.select(*CLAUSE, "op")), CLAUSE), "long-terms-met")
    # their tokens add to the score once, unless a one-token word or prefix adds them
    adding = simple.where("counts").select("query_id", F.col("token").alias("other"), "is_prefix")
    parts = items.select(*PAIR, "term_no", "term", "w").unionByName(ends).join(whole.where("op != '-'"), [*PAIR, "term_no"], "left_semi")
    parts = parts.select(*PAIR, "term", "w").distinct()
    has = (F.col("term") == F.col("other")) | (F.col("is_prefix") & F.col("term").startswith(F.col("other")))
    known = parts.select("query_id", "term").distinct().join(adding, "query_id").where(has).select("query_id", "term").distinct()
    parts = parts.join(known, ["query_id", "term"], "left_anti").select(*PAIR, F.lit(None).cast("string").alias("op"), "w")

    met = at_drivers(word_hits.unionByName(prefix_hits)).unionByName(whole.select(*PAIR, "op", F.lit(0.0).alias("w"))).unionByName(parts)
    totals = met.groupBy(*PAIR).agg(
        F.count_if(F.col("op") == "+").alias("req"), F.count_if(F.col("op") == "-").alias("exc"),
        F.count_if(F.col("op") != "-").alias("pos"), F.sum("w").alias("score_ft"),
    )
    n_req = clauses.groupBy("query_id").agg(F.count_if(F.col("op") == "+").alias("n_req"))
    admitted = totals.join(side(n_req), "query_id").where("req = n_req and exc = 0 and pos > 0")
    return admitted.select(*PAIR, "score_ft")


def boolean_search(specs: list[TableSpec], queries: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """J4 + J2 + W2. Tables without text columns have no hits."""
    cfg = cfg.with_(min_token_len=MIN_TOKEN)
    clauses = store_once(parse_boolean(queries, cfg), "query-clauses")
    found = []
    for s in specs:
        cols = text_columns(s, cfg.fulltext_columns)
        if not cols:
            continue
        hits = scan_scores(s, clauses, cfg.k_ft, cfg)
        if hits is None:
            index = text_index(s, cfg)
            hits = with_keys(index, scored_rows(index, clauses, cfg))
        top = rank_per_table(hits.withColumn("table", F.lit(s.name)), cfg.k_ft, by_score=True)
        found.append(with_snippets(s, top, cols, cfg))
    return lexical_hits(found, queries)
