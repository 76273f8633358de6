"""The index store rewrites only the buckets of changed rows, and a reader keeps the state it loaded."""

from pyspark.sql import functions as F

from lexivec.config import RetrievalConfig
from lexivec.operators.embedding import HashingEmbedder
from lexivec.operators.incremental import incremental_update
from lexivec.operators.rowdocs import row_docs
from lexivec.session import scratch_path
from lexivec.sources.index_store import BUCKETS, IndexStore
from lexivec.sources.tables import TableSpec

CFG = RetrievalConfig(delete_missing=True)
EMB = HashingEmbedder(64)


def docs(spark, rows):
    return row_docs(TableSpec("d", spark.createDataFrame(rows, "doc_id long, text string"), ("doc_id",)), CFG)


def update(spark, store, rows, ts):
    res = incremental_update(store.load(), docs(spark, rows), CFG, EMB, ts, ["d"])
    return store.save(res.index, res.touched) if res.report.first().saved else None


def texts(index):
    return {r.pk: r.chunk for r in index.collect()}


def written(store, version):
    return {b for b, v in store.buckets().items() if v == version}


def test_only_changed_buckets_are_written(spark):
    store = IndexStore(spark, scratch_path(spark, "buckets"))
    rows = [(i, f"some text of row {i}") for i in range(300)]
    assert update(spark, store, rows, 1) == 1 and written(store, 1) == set(range(BUCKETS))
    before = store.load()
    changed = [(i, t + (" edited" if i == 7 else "")) for i, t in rows]
    assert update(spark, store, changed, 2) == 2 and len(written(store, 2)) == 1
    assert texts(store.load())["7"].endswith("edited")
    assert texts(before)["7"].endswith("row 7") and len(texts(store.load())) == 300
    assert update(spark, store, changed, 3) is None
    # one row leaves, one comes: two buckets at most
    assert update(spark, store, [r for r in changed if r[0] != 9] + [(1000, "a new one here")], 4) == 3
    assert len(written(store, 3)) <= 2 and texts(store.load()).keys() == {str(i) for i in [*range(300), 1000]} - {"9"}


def test_emptied_buckets_stay_empty(spark):
    store = IndexStore(spark, scratch_path(spark, "emptied"))
    update(spark, store, [(1, "the first of two"), (2, "the second of two")], 1)
    update(spark, store, [(2, "the second of two")], 2)
    assert texts(store.load()).keys() == {"2"} and store.load().columns == store.empty().columns
    update(spark, store, [], 3)
    assert store.load().count() == 0


def test_filled_in_fingerprints_and_duplicates_are_written(spark):
    store = IndexStore(spark, scratch_path(spark, "filled"))
    update(spark, store, [(i, f"some text of row {i}") for i in range(20)], 1)
    index = store.load()
    copy = index.where("pk = '3'").withColumn("id", F.lit("other"))
    store.save(index.unionByName(copy).withColumn("row_fp", F.when(F.col("pk") != "5", F.col("row_fp"))))
    res = incremental_update(store.load(), docs(spark, [(i, f"some text of row {i}") for i in range(20)]), CFG, EMB, 2, ["d"])
    assert {r.pk for r in res.touched.collect()} == {"3", "5"}
    store.save(res.index, res.touched)
    assert store.load().where("row_fp is null").count() == 0 and store.load().count() == 20
