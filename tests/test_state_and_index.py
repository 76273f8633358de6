"""Keyed state (batch vs plain Python vs stream), guarded SQL, incremental properties, index store."""

import datetime as dt
import json
import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lexivec.config import RetrievalConfig
from lexivec.operators.embedding import HashingEmbedder
from lexivec.operators.incremental import incremental_update, upsert
from lexivec.operators.index_build import build_index
from lexivec.operators.rowdocs import row_docs
from lexivec.plans.sql_guard import guarded_sql
from lexivec.session import scratch_path
from lexivec.sources.index_store import IndexStore
from lexivec.sources.tables import register_views, spec
from lexivec.streaming.keyed_state import FailureBurst, TokenBucket, failure_bursts, token_bucket
from lexivec.streaming.stateful_stream import failure_bursts_stream, token_bucket_stream

TB = TokenBucket(burst=2.0, rate=1.0 / 43200.0)
FB = FailureBurst(max_failures=3, fail_window=2 * 86400.0, open_seconds=86400.0)


def _events(spark):
    return spark.read.parquet(f"{SF_SMALL}/events.parquet")


def _made(spark, seconds_and_types):
    """Events of one user at the given seconds."""
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), 7, t, 0.0, "{}") for i, (s, t) in enumerate(seconds_and_types)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")


H = 3600


def test_token_bucket_by_hand(spark):
    """Two tokens at first, one more every 12 hours, two at most."""
    cases = [(0, True), (1, True), (2, False), (11 * H, False), (12 * H + 1, True), (12 * H + 2, False), (100 * H, True), (100 * H, True), (100 * H, False)]
    got = {r["event_id"]: r["admitted"] for r in token_bucket(_made(spark, [(s, "click") for s, _ in cases]), TB).collect()}
    assert [got[i] for i in range(len(cases))] == [ok for _, ok in cases]


def test_token_bucket_never_admits_more_than_its_rate(spark, events_pdf):
    got = {r["event_id"]: r["admitted"] for r in token_bucket(_events(spark), TB).collect()}
    assert len(got) == len(events_pdf) and not all(got.values())
    for _, own in events_pdf.sort_values("us").groupby("user_id"):
        times = [us / 1e6 for us, e in zip(own.us, own.event_id, strict=True) if got[e]]
        assert got[own.event_id.iloc[0]]
        for i in range(len(times)):
            for j in range(i, len(times)):
                assert j - i + 1 <= 2 + (times[j] - times[i]) / 43200.0 + 1e-6


def test_failure_bursts_by_hand(spark):
    """Three failures within two days open the breaker for one day; a success ends a burst; a
    window that is over starts anew."""
    day = 86400
    cases = [
        (0, "error", "failure"), (10, "error", "failure"), (20, "click", "ok"), (30, "error", "failure"), (40, "error", "failure"), (50, "error", "opened"),
        (60, "click", "blocked"), (70, "error", "blocked"), (day + 51, "click", "ok"), (day + 52, "error", "failure"), (5 * day, "error", "failure"),
        (5 * day + 1, "error", "failure"), (5 * day + 2, "error", "opened"),
    ]
    got = {r["event_id"]: r["outcome"] for r in failure_bursts(_made(spark, [(s, t) for s, t, _ in cases]), FB).collect()}
    assert [got[i] for i in range(len(cases))] == [o for _, _, o in cases]


def test_nothing_passes_while_a_breaker_is_open(spark, events_pdf):
    got = {r["event_id"]: r["outcome"] for r in failure_bursts(_events(spark), FB).collect()}
    assert len(got) == len(events_pdf) and {"ok", "failure", "opened"} <= set(got.values())
    for _, own in events_pdf.sort_values("us").groupby("user_id"):
        opened = None
        for us, e, kind in zip(own.us, own.event_id, own.event_type, strict=True):
            inside = opened is not None and us / 1e6 - opened < 86400
            assert (got[e] == "blocked") == inside
            if not inside:
                assert (got[e] == "ok") == (kind != "error")
                opened = us / 1e6 if got[e] == "opened" else None


@pytest.fixture(scope="module")
def events_pdf(spark):
    return _events(spark).select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).toPandas()


def _stream_vs_batch(spark, stream_fn, batch_df, cols):
    base = scratch_path(spark, "state-stream")
    ev = _events(spark)
    # three landing files in time order, so every micro-batch comes after the previous one
    ordered = ev.withColumn("_p", F.ntile(3).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("ts", "event_id")))
    for p in (1, 2, 3):
        ordered.where(F.col("_p") == p).drop("_p").coalesce(1).write.parquet(f"{base}/in/p={p}")
    src = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    q = (
        stream_fn(src)
        .writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/ckpt")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    got = spark.read.parquet(f"{base}/out").select(*cols).orderBy("event_id").toPandas()
    want = batch_df.select(*cols).orderBy("event_id").toPandas()
    pd.testing.assert_frame_equal(got.reset_index(drop=True), want.reset_index(drop=True), check_dtype=False)


def test_token_bucket_stream_equals_batch(spark):
    _stream_vs_batch(spark, lambda s: token_bucket_stream(s, TB), token_bucket(_events(spark), TB), ["event_id", "key", "admitted"])


def test_failure_bursts_stream_equals_batch(spark):
    _stream_vs_batch(spark, lambda s: failure_bursts_stream(s, FB), failure_bursts(_events(spark), FB), ["event_id", "key", "outcome", "failures"])


# ---------------------------------------------------------------- guarded SQL
@pytest.mark.parametrize(
    "q,ok,limited",
    [
        ("SELECT r_name FROM region", True, True),
        ("select r_name from region;", True, True),
        ("SELECT r_name FROM region LIMIT 2;;", True, False),
        ("SELECT * FROM (SELECT r_name FROM region LIMIT 3) t", True, True),  # LIMIT only inside: capped
        ("SELECT 'x LIMIT y' AS s FROM region", True, True),
        ("WITH t AS (SELECT 1 AS a) SELECT a FROM t", False, None),
        ("(SELECT r_name FROM region)", False, None),
        ("INSERT INTO region VALUES (9, 'x')", False, None),
        ("SELECT 1; SELECT 2", False, None),
        ("SELECT r_name FROM region OFFSET 1", True, True),  # an OFFSET bounds nothing
        ("SELECT r_name FROM region LIMIT 3 OFFSET 1", True, False),
        ("SELECT nope FROM region", False, None),
    ],
)
def test_sql_guard(spark, q, ok, limited):
    register_views(spark, SF_SMALL)
    r = guarded_sql(spark, q, limit_default=2)
    assert (r.error is None) == ok, r.error
    if ok:
        assert r.limited == limited
        n = len(r.df.collect())
        assert n <= (2 if limited else 3)


def test_sql_params(spark):
    register_views(spark, SF_SMALL)
    r = guarded_sql(spark, "SELECT count(*) AS n FROM orders WHERE o_orderstatus = :s", {"s": "F"})
    assert r.error is None and r.df.first()["n"] > 0


# ---------------------------------------------------------------- incremental properties
CFG = RetrievalConfig()


def test_update_with_same_snapshot_is_noop(spark):
    emb = HashingEmbedder(64)
    docs = spec(spark, SF_SMALL, "documents")
    idx = build_index([docs], CFG, emb, 1)
    r = incremental_update(idx, row_docs(docs, CFG), CFG, emb, 2, ["documents"])
    rep = r.report.first().asDict()
    n_rows = docs.df.count()
    assert rep["added_vectors"] == 0 and rep["reembedded_rows"] == 0
    assert rep["skipped_rows"] == n_rows
    # only genuinely repeated chunks inside a row are compacted
    assert rep["total_meta"] == idx.count() - rep["deleted_vectors"]


def test_incremental_equals_rebuild(spark):
    from lexivec.plans.q_incremental import _v1, _v2

    emb = HashingEmbedder(64)
    v1, v2 = _v1(spark, SF_SMALL), _v2(spark, SF_SMALL)
    idx1 = build_index([v1], CFG, emb, 1)
    inc = incremental_update(idx1, row_docs(v2, CFG), CFG.with_(delete_missing=True), emb, 2, ["documents"]).index
    full = build_index([v2], CFG, emb, 2)
    a = {(r["id"], r["row_fp"], tuple(r["embedding"])) for r in inc.select("id", "row_fp", "embedding").collect()}
    b = {(r["id"], r["row_fp"], tuple(r["embedding"])) for r in full.select("id", "row_fp", "embedding").collect()}
    # equal up to the compaction of repeated chunks inside unchanged rows
    assert a <= b and len(b - a) <= 3


def test_upsert_last_write_wins(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "id string, v int, seq int")
    got = {r["id"]: r["v"] for r in upsert(base, new, "seq").collect()}
    assert got == {"a": 1, "b": 3, "c": 4}


# ---------------------------------------------------------------- index store
def test_index_store_versions_and_legacy(spark):
    store = IndexStore(spark, scratch_path(spark, "store"))
    assert store.current_version() is None and store.load().count() == 0
    emb = HashingEmbedder(64)
    idx = build_index([spec(spark, SF_SMALL, "documents")], CFG, emb, 1)
    assert store.save(idx) == 1
    assert store.save(idx.limit(3)) == 2
    assert store.current_version() == 2 and store.load().count() == 3
    d = tempfile.mkdtemp(prefix="legacy-", dir="/tmp")
    p1, p2 = os.path.join(d, "a.json"), os.path.join(d, "b.json")
    with open(p1, "w") as f:
        json.dump([{"table": "t", "pk": "1", "chunk": "hello", "id": "t::1::0"}, {"table": "t", "pk": "2", "chunk": "x", "indexed_at": 5}], f)
    with open(p2, "w") as f:
        json.dump({"dim": 64, "meta": [{"table": "t", "pk": "3", "chunk": "c", "row_fp": "ab"}]}, f)
    a = {r["pk"]: r["indexed_at"] for r in store.load_legacy_json(p1, 99).collect()}
    assert a == {"1": 99, "2": 5}
    b = store.load_legacy_json(p2, 7).collect()
    assert len(b) == 1 and b[0]["row_fp"] == "ab" and b[0]["indexed_at"] == 7


def test_load_or_build_and_resolve_columns(spark):
    from lexivec.sources.index_store import load_or_build
    from lexivec.sources.tables import catalog_columns, resolve_index_columns

    store = IndexStore(spark, scratch_path(spark, "lob"))
    assert load_or_build(store, lambda: None, auto_index=False) is None
    emb = HashingEmbedder(64)
    idx = load_or_build(store, lambda: build_index([spec(spark, SF_SMALL, "part")], CFG, emb, 1))
    assert idx.count() == spark.read.parquet(f"{SF_SMALL}/part.parquet").count()
    assert load_or_build(store, lambda: 1 / 0).count() == idx.count()  # loaded, not rebuilt

    cat = catalog_columns(spark, [spec(spark, SF_SMALL, t) for t in ("part", "documents", "orders")])
    valid, missing = resolve_index_columns(spark, cat, ["documents.text", "part.p_name", "part.nope", "orders", "lineitem.x"])
    assert sorted(r["spec"] for r in valid.collect()) == ["documents.text", "part.p_name"]
    assert sorted(r["spec"] for r in missing.collect()) == ["lineitem.x", "orders", "part.nope"]
    # allow-list drops part; nothing valid left in the list -> auto discovery of allowed tables
    valid2, _ = resolve_index_columns(spark, cat, ["part.p_name"], allow_list=("documents",))
    assert sorted(r["spec"] for r in valid2.collect()) == ["documents.lang", "documents.source", "documents.text"]
    valid3, _ = resolve_index_columns(spark, cat, ["nope.x"], auto_discover=False)
    assert valid3.count() == 0


def test_index_store_skips_uncommitted_version(spark):
    store = IndexStore(spark, scratch_path(spark, "store-crash"))
    emb = HashingEmbedder(64)
    idx = build_index([spec(spark, SF_SMALL, "part")], CFG, emb, 1)
    assert store.save(idx) == 1
    os.makedirs(store.path(2).replace("file:", ""), exist_ok=True)  # a write that died: no _SUCCESS
    assert store.current_version() == 1
    assert store.save(idx.limit(2)) == 3
    assert store.current_version() == 3 and store.load().count() == 2


# ---------------------------------------------------------------- snapshots, models, folders
def test_snapshots_of_several_files_and_late_manifests(spark):
    from lexivec.plans.q_incremental import _v1, _v2
    from lexivec.plans.q_stream import drain, land, run_stream_incremental

    cfg = CFG.with_(delete_missing=True)
    log, store, base = run_stream_incremental(spark, SF_SMALL, cfg)
    runs = {r["snapshot"]: r for r in log.collect()}
    missing = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("doc_id % 10 = 0").count()
    assert runs[1]["deleted_rows"] == 0 and runs[2]["deleted_rows"] == missing
    before = store.load().count()
    land(spark, base, 0, _v1(spark, SF_SMALL).df)  # an older snapshot that arrives late
    drain(spark, base, store, cfg)
    assert store.load().count() == before and spark.read.parquet(f"{base}/run_log").count() == 2
    land(spark, base, 3, _v2(spark, SF_SMALL).df)
    drain(spark, base, store, cfg)
    last = spark.read.parquet(f"{base}/run_log").where("snapshot = 3").first()
    assert not last["saved"] and last["deleted_rows"] == 0 and last["added_vectors"] == 0


def test_model_vectors_are_normalised_and_cached_by_model(spark):
    import numpy as np

    from lexivec.operators.embedding import PandasEmbedder
    from lexivec.sources.index_cache import cached_index
    from lexivec.sources.tables import table_path

    def model(axis):
        return lambda texts: np.eye(4)[np.full(len(texts), axis)] * 3.0

    part = spec(spark, SF_SMALL, "part")
    index = lambda e: cached_index(spark, [part], [table_path(SF_SMALL, "part")], CFG, e, 1)
    one, two = (index(PandasEmbedder(model(i), 4, f"m{i}")).first()["embedding"] for i in (0, 1))
    assert one == [1.0, 0.0, 0.0, 0.0] and two == [0.0, 1.0, 0.0, 0.0]
    with pytest.raises(ValueError, match="names its model"):
        index(PandasEmbedder(model(0), 4))


def test_nan_vectors_do_not_displace_neighbours(spark):
    from lexivec.operators.vector_search import vector_topk

    rows = [(i, [float("nan"), 1.0]) for i in range(20)] + [(100 + i, [1.0, i / 10]) for i in range(5)]
    corpus = spark.createDataFrame(rows, "id long, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, qvec array<float>")
    got = vector_topk(corpus, q, 3, 2, normalise_corpus=True).orderBy("rnk").collect()
    assert [r["id"] for r in got] == [100, 101, 102]


def test_a_cluster_needs_a_shared_folder():
    from lexivec.session import work_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(Session())


def test_deletes_by_id_and_row(spark):
    from lexivec.operators.incremental import delete_ids, delete_rows

    index = spark.createDataFrame([("a", "t", "1"), ("b", "t", "1"), ("c", "t", "2"), ("d", "u", "1")], "id string, table string, pk string")
    left = lambda df: sorted(r["id"] for r in df.collect())
    ids = spark.createDataFrame([("a",), ("x",)], "id string")
    assert left(delete_ids(index, ids)) == ["b", "c", "d"] and left(delete_ids(index, ids.limit(0))) == ["a", "b", "c", "d"]
    assert left(delete_rows(index, spark.createDataFrame([("t", "1")], "table string, pk string"))) == ["c", "d"]


def test_wrong_dimensions_and_empty_corpora_are_errors(spark):
    from lexivec.functions.vectors import check_dim
    from lexivec.sources.index_store import load_or_build

    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<float>").coalesce(1)
    assert df.limit(1).select(check_dim("v", 2).alias("v")).first()["v"] == [1.0, 2.0]
    with pytest.raises(Exception, match="dimension mismatch"):
        df.select(check_dim("v", 2)).collect()
    store = IndexStore(spark, scratch_path(spark, "empty"))
    with pytest.raises(RuntimeError, match="No texts"):
        load_or_build(store, store.empty)
    assert store.current_version() is None


def test_entries_without_a_key_are_preserved(spark):
    """Rows whose text falls under the minimum lose their entries; entries without a key stay."""
    emb = HashingEmbedder(64)
    docs = spec(spark, SF_SMALL, "part")
    idx = build_index([docs], CFG, emb, 1)
    no_key = idx.limit(2).withColumn("pk", F.lit(None).cast("string")).withColumn("id", F.concat(F.lit("nokey::"), "id"))
    current = row_docs(docs, CFG).withColumn("text", F.when(F.col("pk") == "1", F.lit("x")).otherwise(F.col("text")))
    current = current.withColumn("row_fp", F.when(F.col("pk") == "1", F.lit("changed")).otherwise(F.col("row_fp")))
    r = incremental_update(idx.unionByName(no_key), current, CFG, emb, 2, ["part"])
    out = r.index
    assert out.where("id like 'nokey::%'").count() == 2
    assert out.where("pk = '1'").count() == 0 and idx.where("pk = '1'").count() == 1
    assert out.count() == idx.count() - 1 + 2
