"""Index table storage (S8, S9, S16): Parquet folders in the shared work folder.

A row's entries are in one of ``BUCKETS`` hash buckets of (table, pk). ``<root>/v=<n>/bucket=<b>/`` holds
the buckets that version n rewrote: all of them for a whole index, only those of the changed rows for an
update. A reader takes each bucket from the last committed version that has it, once, when it loads; no
file is ever changed, so it sees one state of the index throughout. A version is committed once Spark's
job commit has written its ``_SUCCESS`` marker. A bucket that a version empties holds one placeholder row.
Pruning old versions is an operator decision.

Paths go through the Hadoop FileSystem API, so the same code works on HDFS / object stores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("pk", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("chunk_idx", T.IntegerType()),
        T.StructField("chunk", T.StringType()),
        T.StructField("doc_name", T.StringType()),
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("temporal", T.MapType(T.StringType(), T.StringType())),
        T.StructField("row_fp", T.StringType()),
        T.StructField("indexed_at", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)


BUCKETS = 64
STORED = T.StructType([*INDEX_SCHEMA.fields, T.StructField("placeholder", T.BooleanType())])


def bucket_of() -> Column:
    return F.pmod(F.xxhash64(F.coalesce("table", F.lit("")), F.coalesce("pk", F.lit(""))), F.lit(BUCKETS)).cast("int")


class IndexStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        jvm = spark._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self, committed_only: bool = True) -> list[int]:
        root = self._Path(self.root)
        if not self._fs.exists(root):
            return []
        out = []
        for st in self._fs.listStatus(root):
            name = st.getPath().getName()
            if name.startswith("v=") and name[2:].isdigit():
                if not committed_only or self._fs.exists(self._Path(st.getPath(), "_SUCCESS")):
                    out.append(int(name[2:]))
        return sorted(out)

    def current_version(self) -> int | None:
        v = self._versions()
        return v[-1] if v else None

    def path(self, version: int) -> str:
        return f"{self.root}/v={version}"

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], INDEX_SCHEMA)

    def buckets(self) -> dict[int, int]:
        """The last committed version of every bucket."""
        out = {}
        for v in self._versions():
            for st in self._fs.listStatus(self._Path(self.path(v))):
                name = st.getPath().getName()
                if name.startswith("bucket="):
                    out[int(name[7:])] = v
        return out

    def load(self) -> DataFrame:
        """The committed index, or an empty one."""
        found = self.buckets()
        if not found:
            return self.empty()
        paths = [f"{self.path(v)}/bucket={b}" for b, v in sorted(found.items())]
        return self.spark.read.schema(STORED).parquet(*paths).where("placeholder is null").drop("placeholder")

    def save(self, index: DataFrame, touched: DataFrame | None = None) -> int:
        """Write ``index`` as a new version. ``touched``: the (table, pk) whose entries differ from
        the stored ones; only their buckets are written then. Readers switch when the commit marker exists."""
        # a write that died leaves a folder without a commit marker: never reuse its number
        v = max(self._versions(committed_only=False) or [0]) + 1
        every = list(range(BUCKETS))
        if touched is not None and self.current_version() is not None:
            every = sorted(r[0] for r in touched.select(bucket_of().alias("b")).distinct().collect())  # BUCKETS at most
        rows = index.select(*INDEX_SCHEMA.names, F.lit(None).cast("boolean").alias("placeholder"), bucket_of().alias("bucket"))
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in INDEX_SCHEMA.fields]
        marks = self.spark.createDataFrame([(b,) for b in every], "bucket int").select(*nulls, F.lit(True).alias("placeholder"), "bucket")
        rows = rows.where(F.col("bucket").isin(every)).unionByName(marks)
        rows.hint("rebalance", "bucket").write.mode("errorifexists").partitionBy("bucket").parquet(self.path(v))
        return v

    def load_legacy_json(self, path: str, now_ts: int) -> DataFrame:
        """S8, old manifest formats: ``{"dim", "meta": [...]}`` or a bare JSON list of entries.
        Entries without ``indexed_at`` are back-filled with ``now_ts``; non-object entries are
        skipped (they fail to parse into the struct and come back all-NULL)."""
        raw = self.spark.read.option("multiLine", "true").json(path)
        entries = raw.select(F.explode("meta").alias("m")).select("m.*") if "meta" in raw.columns else raw
        cols = set(entries.columns)

        def col(name, dt):
            return (F.col(name) if name in cols else F.lit(None)).cast(dt).alias(name)

        out = entries.select(
            col("id", "string"), col("table", "string"), col("pk", "string"), col("column", "string"),
            col("chunk_idx", "int"), col("chunk", "string"), col("doc_name", "string"), col("columns", "array<string>"),
            F.lit(None).cast("map<string,string>").alias("temporal"), col("row_fp", "string"),
            F.coalesce(col("indexed_at", "long"), F.lit(now_ts).cast("long")).alias("indexed_at"),
            F.lit(None).cast("array<float>").alias("embedding"),
        )
        return out.where(F.col("table").isNotNull() | F.col("pk").isNotNull() | F.col("chunk").isNotNull())


def load_or_build(store: IndexStore, build, auto_index: bool = True, initial_build: bool = True) -> DataFrame | None:
    """A committed index is loaded; otherwise it is built (and saved) when automatic
    indexing and the initial build are on; else there is no index (retrieval returns nothing).
    Building from an empty corpus is an error."""
    from lexivec.operators.chunking import assert_nonempty

    if store.current_version() is not None:
        return store.load()
    if auto_index and initial_build:
        store.save(assert_nonempty(build()))
        return store.load()
    return None
