"""Stored indexes of a table's texts: built once per version of its rows, read by every search.

**Full text** (``text_index``): four Parquet tables under one folder of the shared work folder:

* ``docs(did, pk)``: a number for every row;
* ``postings(term, did, level, imp, pos)``: sorted by term, within a term by impact. ``imp`` is the
  BM25 weight without the idf, ``level`` its sixteenth of the greatest possible one (the block a
  search can skip), ``pos`` the token positions in order;
* ``blocks(term, level, n, top, low)``: rows of a block, its highest and lowest impact;
* ``terms(term, df, idf, top, head)``: the vocabulary sorted by term, so a prefix is a range;
  ``head`` is the first two characters.

**Substrings** (``gram_index``) of the first text column, lower-cased:

* ``rows(did, pk, lt)``: the texts;
* ``grams(gram, did)``: the distinct runs of three characters of each text (a shorter text is a run
  by itself), sorted by run;
* ``terms(gram, n)``: how many texts have a run.

Range partitioning by (term, did) also splits the postings of a term that is in every row.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.config import RetrievalConfig
from lexivec.functions.text import tokens
from lexivec.operators.plan_utils import spread
from lexivec.session import scratch_path, work_dir
from lexivec.sources.tables import TableSpec, type_class

LEVELS = 16


def text_columns(spec: TableSpec, n: int) -> list[str]:
    """First ``n`` text-typed columns by ordinal."""
    return [f.name for f in spec.fields() if type_class(f.dataType) == "text"][:n]


@dataclass(frozen=True)
class TextIndex:
    docs: DataFrame
    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame


def doc_tokens(spec: TableSpec, cfg: RetrievalConfig) -> DataFrame:
    """``(pk, toks)``: tokens of the first ``fulltext_columns`` text columns, in order, with an empty
    token after each column, so that no phrase runs across columns."""
    cols = text_columns(spec, cfg.fulltext_columns)
    none = F.array().cast("array<string>")
    toks = F.flatten(F.array(*[F.concat(F.coalesce(tokens(F.col(f"`{c}`"), cfg.min_token_len), none), F.array(F.lit(""))) for c in cols]))
    return spread(spec.df).select(spec.pk_col().alias("pk"), toks.alias("toks")).where("pk is not null")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder that this package wrote for its own use."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored_place(spec: TableSpec, kind: str, settings: list) -> tuple[str, bool]:
    """(folder, complete): a folder that stands for these rows and settings. It is known by the
    plan and by path, size and time of every file that the plan reads; rows that come from no file
    get a fresh folder."""
    spark = spec.df.sparkSession
    files = spec.df.inputFiles()
    plan = spec.df._jdf.queryExecution().analyzed().canonicalized().toString()
    if not files or "LocalRelation" in plan or "LogicalRDD" in plan:
        return scratch_path(spark, kind), False
    conf, path_of = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    stamps = []
    for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
        place = path_of(folder)
        stamps += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in place.getFileSystem(conf).listStatus(place)]
    key = json.dumps([kind, plan, sorted(stamps), spec.name, spec.pk, settings], default=str)
    root = f"{work_dir(spark)}/{kind}/{hashlib.sha256(key.encode()).hexdigest()[:24]}"
    return root, exists(spark, f"{root}/terms/_SUCCESS")


def text_index(spec: TableSpec, cfg: RetrievalConfig) -> TextIndex | None:
    """The index of a table, built if it is not stored yet; None for a table without text columns."""
    if not text_columns(spec, cfg.fulltext_columns):
        return None
    spark = spec.df.sparkSession
    root, complete = stored_place(spec, "text-index", [cfg.fulltext_columns, cfg.min_token_len, cfg.bm25_k1, cfg.bm25_b])
    if not complete:
        build(spec, cfg, root)
    return TextIndex(*(spark.read.parquet(f"{root}/{t}") for t in ("docs", "postings", "blocks", "terms")))


def build(spec: TableSpec, cfg: RetrievalConfig, root: str) -> None:
    spark, k1, b = spec.df.sparkSession, cfg.bm25_k1, cfg.bm25_b

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    # the row number is stored with the row, so that a task run again cannot change it
    toks = write(doc_tokens(spec, cfg).withColumn("did", F.monotonically_increasing_id()).withColumn("dl", F.size(F.array_remove("toks", ""))), "tokens")
    write(toks.select("did", "pk"), "docs")
    n_docs, avgdl = toks.agg(F.count("*"), F.avg("dl")).first()
    occ = toks.select("did", "dl", F.posexplode("toks").alias("pos", "term")).where("term != ''")
    # one shuffle: ranges of (term, did) also serve the aggregate and the sorted files
    post = occ.repartitionByRange("term", "did").groupBy("term", "did").agg(
        F.first("dl").alias("dl"), F.sort_array(F.collect_list("pos")).alias("pos")
    )
    tf = F.size("pos").cast("double")
    imp = tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * F.col("dl") / F.lit(avgdl or 1.0)))
    level = F.greatest(F.lit(1), F.least(F.lit(LEVELS), F.ceil(F.col("imp") * LEVELS / (k1 + 1.0)).cast("int")))
    post = post.withColumn("imp", imp).withColumn("level", level).select("term", "did", "level", "imp", "pos")
    post = write(post.sortWithinPartitions("term", F.col("level").desc(), "did"), "postings")
    blocks = post.groupBy("term", "level").agg(F.count("*").alias("n"), F.max("imp").alias("top"), F.min("imp").alias("low"))
    blocks = write(blocks.repartitionByRange("term").sortWithinPartitions("term", "level"), "blocks")
    terms = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top"))
    idf = F.log(1.0 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = terms.select("term", "df", idf.alias("idf"), "top", F.substring("term", 1, 2).alias("head"))
    write(terms.repartitionByRange("term").sortWithinPartitions("term"), "terms")  # its marker completes the index
    drop(spark, f"{root}/tokens")


GRAM = 3


@dataclass(frozen=True)
class GramIndex:
    rows: DataFrame
    grams: DataFrame
    counts: DataFrame


def runs_of(text: str) -> Column:
    """All runs of ``GRAM`` characters in a text; a shorter text is one run, an empty one none."""
    last = F.greatest(F.length(text) - GRAM, F.lit(0))
    # the characters are an argument of the outer function, so that they are split once; a slice
    # costs the same at any place of a long text
    cut = lambda chars: F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice(chars, i, GRAM), ""))
    return F.transform(F.array(F.split(text, "")), cut)[0]


def distinct_runs(text: str) -> Column:
    """The same for whole texts, each run once."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list({t[i : i + GRAM] for i in range(max(1, len(t) - GRAM + 1))}))

    return cut(text)


def texts_of(spec: TableSpec, column: str) -> DataFrame:
    """``(pk, lt)``: the lower-cased texts of a column."""
    rows = spread(spec.df).select(spec.pk_col().alias("pk"), F.lower(F.col(f"`{column}`")).alias("lt"))
    return rows.where("lt is not null and pk is not null")


def gram_index(spec: TableSpec) -> GramIndex | None:
    """The index of the first text column, built if it is not stored yet; None without one."""
    cols = text_columns(spec, 1)
    if not cols:
        return None
    spark = spec.df.sparkSession
    root, complete = stored_place(spec, "gram-index", cols)
    if not complete:

        def write(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{root}/{name}")
            return spark.read.parquet(f"{root}/{name}")

        rows = write(texts_of(spec, cols[0]).select(F.monotonically_increasing_id().alias("did"), "pk", "lt"), "rows")
        grams = rows.where("lt != ''").select("did", F.explode(distinct_runs("lt")).alias("gram"))
        grams = write(grams.select("gram", "did").repartitionByRange("gram", "did").sortWithinPartitions("gram", "did"), "grams")
        write(grams.groupBy("gram").agg(F.count("*").alias("n")), "terms")  # its marker completes the index
    return GramIndex(*(spark.read.parquet(f"{root}/{t}") for t in ("rows", "grams", "terms")))
