"""Index maintenance (U1-U12, S10-S12, B4, A2-A4): change detection by fingerprint, duplicate
compaction, re-embedding of changed rows only, optional deletes, and the update report.

One pass, all joins keyed by (table, pk):

    stored index ──groupBy(table,pk)──► stored fingerprint ─┐
                                                            ├─ full outer join ─► change class
    current rows (fingerprints only) ───────────────────────┘
        unchanged ─► stored entries ─► row_number over (table, pk, chunk) = 1 ─► kept (fp back-filled)
        new/changed ─► current text ─► chunks ─► embed (only these rows) ─► added
        missing ─► kept as is, or dropped when ``delete_missing``
    untouched entries (other tables / keys) ─────────────────────────────────► kept

The embedder runs after the join, so only new and changed rows reach it; Catalyst does not move
work through a Python operator, so this order is set here on purpose.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.config import ID_SEP, RetrievalConfig
from lexivec.operators.chunking import chunk_docs, fallback_id, id_index, legacy_fingerprint
from lexivec.operators.embedding import Embedder
from lexivec.operators.index_build import INDEX_COLUMNS
from lexivec.session import store_once

KEY = ["table", "pk"]


@dataclass
class UpdateResult:
    index: DataFrame  # the new index (all entries)
    classes: DataFrame  # (table, pk, change, n_existing)
    deleted_ids: DataFrame  # (id) of entries removed
    report: DataFrame  # one row of counters
    touched: DataFrame  # (table, pk) of rows whose entries differ from the stored ones


def _ord(df: DataFrame) -> Column:
    """Stored order proxy: the chunk index (from the column or the ID), then the ID."""
    idx = F.coalesce(F.col("chunk_idx"), id_index("id")) if "chunk_idx" in df.columns else id_index("id")
    return F.struct(idx.alias("i"), F.col("id").alias("id"))


def stored_fingerprints(stored: DataFrame) -> DataFrame:
    """Per row, the first non-empty stored fingerprint, else one rebuilt from its chunks.

    The rebuild (which needs the chunk texts) only runs for rows without any stored fingerprint.
    """
    s = stored.where(F.col("table").isNotNull() & F.col("pk").isNotNull())
    has_fp = F.col("row_fp").isNotNull() & (F.col("row_fp") != "")
    summ = s.groupBy(*KEY).agg(
        F.min_by(F.when(has_fp, F.col("row_fp")), F.when(has_fp, _ord(s))).alias("stored_fp"),
        F.count(F.lit(1)).alias("n_existing"),
    )
    need = summ.where(F.col("stored_fp").isNull()).select(*KEY)
    legacy = legacy_fingerprint(s.join(need, KEY, "left_semi").select("id", "table", "pk", "chunk"))
    return (
        summ.join(legacy, KEY, "left")
        .select(*KEY, F.coalesce("stored_fp", "legacy_fp").alias("prev_fp"), "n_existing")
    )


def classify(current: DataFrame, prev: DataFrame) -> DataFrame:
    """U4: unchanged / changed / new / missing, by a full outer join on (table, pk)."""
    cur = current.select(*KEY, F.col("row_fp").alias("new_fp"))
    j = cur.join(prev, KEY, "full_outer")
    change = (
        F.when(F.col("prev_fp").isNull() & F.col("n_existing").isNull(), F.lit("new"))
        .when(F.col("new_fp").isNull(), F.lit("missing"))
        .when(F.col("prev_fp").eqNullSafe(F.col("new_fp")), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )
    return j.select(*KEY, "new_fp", change.alias("change"), F.coalesce("n_existing", F.lit(0)).cast("long").alias("n_existing"))


def compact_unchanged(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Among the entries of one unchanged row with equal chunk text keep one (an ID of the
    deterministic ``table::pk::`` form first, else the first stored); back-fill the fingerprint.

    ``entries`` carries ``new_fp`` and ``_ck``, the chunk's SHA-256: what only counts or compares does not
    shuffle texts. Returns ``(kept, deleted_ids)``.
    """
    prefix = F.concat(F.col("table"), F.lit(ID_SEP), F.col("pk"), F.lit(ID_SEP))
    w = Window.partitionBy("table", "pk", "_ck").orderBy(F.col("_det").desc(), F.col("_ord").asc())
    ranked = (
        entries.withColumn("_det", F.col("id").startswith(prefix))
        .withColumn("_ord", _ord(entries))
        .withColumn("_rn", F.row_number().over(w))
    )
    kept = ranked.where(F.col("_rn") == 1).withColumn("row_fp", F.col("new_fp")).drop("_ck", "_det", "_ord", "_rn", "new_fp")
    deleted = ranked.where((F.col("_rn") > 1) & F.col("id").isNotNull()).select("id")
    return kept, deleted


def incremental_update(
    stored: DataFrame,
    current: DataFrame,
    cfg: RetrievalConfig,
    embedder: Embedder,
    now_ts: int,
    target_tables: list[str],
) -> UpdateResult:
    """U1-U12. ``stored``: index entries; ``current``: row documents of the snapshot.

    ``target_tables`` are the tables whose columns were resolved for indexing (S6), named by the
    caller: a table that has lost all its rows is still a target, so its entries count as missing.
    Entries without a table belong to no target and are preserved.
    """
    target_tables = sorted(set(target_tables))
    stored = stored.withColumn("id", F.coalesce(F.col("id"), fallback_id(F.col("table"), F.col("pk"), F.col("chunk"))))
    in_target = F.coalesce(F.col("table").isin(target_tables), F.lit(False))
    st_t = stored.where(in_target & F.col("pk").isNotNull()).withColumn("_ck", F.sha2(F.coalesce("chunk", F.lit("")), 256))
    cur = current.where(in_target)

    # Read by six branches and the report: written once.
    classes = store_once(classify(cur, stored_fingerprints(st_t)), "change-classes")
    cls_small = classes.select(*KEY, "change", "new_fp")

    # unchanged rows: compaction over their stored entries
    unchanged = cls_small.where(F.col("change") == "unchanged")
    kept, compact_deleted = compact_unchanged(st_t.join(unchanged, KEY, "inner").drop("change"))

    # new / changed rows: re-chunk and embed only these
    redo = cls_small.where(F.col("change").isin("new", "changed")).select(*KEY)
    new_chunks = chunk_docs(cur.join(redo, KEY, "left_semi"), cfg, now_ts)
    added = store_once(embedder.embed_df(new_chunks, "chunk", "embedding").select(*INDEX_COLUMNS), "added-entries")

    # entries replaced (changed rows) or removed (missing rows, when enabled)
    drop_change = ["changed"] + (["missing"] if cfg.delete_missing else [])
    dropped_keys = cls_small.where(F.col("change").isin(drop_change)).select(*KEY)
    replaced_deleted = st_t.join(dropped_keys, KEY, "left_semi").select("id")

    # untouched: other tables, plus stored rows of target tables that were not touched
    touched = cls_small.where(F.col("change") != "missing").select(*KEY).unionByName(dropped_keys.where(F.lit(cfg.delete_missing)))
    untouched = stored.where(~in_target | F.col("pk").isNull()).unionByName(
        st_t.drop("_ck").join(touched, KEY, "left_anti")
    )
    new_index = untouched.select(*INDEX_COLUMNS).unionByName(kept.select(*INDEX_COLUMNS)).unionByName(added)
    deleted_ids = compact_deleted.unionByName(replaced_deleted)
    report = update_report(classes, added, compact_deleted, new_index, target_tables, cfg)
    # unchanged rows differ where a duplicate goes or a fingerprint is filled in
    same = st_t.join(unchanged, KEY).groupBy(*KEY, "_ck").agg(
        ((F.count("*") > 1) | F.bool_or(~F.col("row_fp").eqNullSafe(F.col("new_fp")))).alias("_differs")
    )
    differing = redo.unionByName(dropped_keys).unionByName(same.where("_differs").select(*KEY)).distinct()
    return UpdateResult(new_index, classes.drop("new_fp"), deleted_ids, report, differing)


def update_report(classes, added, compact_deleted, new_index, target_tables, cfg) -> DataFrame:
    """The counters of one run as a one-row DataFrame (small aggregates, cross-joined)."""
    c = classes.agg(
        F.count_if(F.col("change") == "unchanged").cast("long").alias("skipped_rows"),
        F.coalesce(F.sum(F.when(F.col("change") == "changed", F.col("n_existing"))), F.lit(0)).cast("long").alias("_del_changed"),
        F.coalesce(
            F.sum(F.when((F.col("change") == "missing") & F.lit(cfg.delete_missing), F.col("n_existing"))), F.lit(0)
        ).cast("long").alias("_del_missing"),
        F.count_if((F.col("change") == "missing") & F.lit(cfg.delete_missing)).cast("long").alias("deleted_rows"),
    )
    a = added.agg(
        F.count(F.lit(1)).cast("long").alias("added_vectors"),
        F.countDistinct("table", "pk").cast("long").alias("reembedded_rows"),
    )
    d = compact_deleted.agg(F.count(F.lit(1)).cast("long").alias("_del_compact"))
    t = new_index.agg(F.count(F.lit(1)).cast("long").alias("total_meta"))
    r = c.crossJoin(a).crossJoin(d).crossJoin(t)
    deleted_vectors = F.col("_del_changed") + F.col("_del_missing") + F.col("_del_compact")
    return r.select(
        F.lit(",".join(target_tables)).alias("tables"),
        "added_vectors",
        "reembedded_rows",
        "skipped_rows",
        deleted_vectors.alias("deleted_vectors"),
        "deleted_rows",
        "total_meta",
        ((F.col("added_vectors") + F.col("reembedded_rows") + deleted_vectors) > 0).alias("saved"),
    )


# ---------------------------------------------------------------------------
# S10-S12, B4 as standalone operators
# ---------------------------------------------------------------------------
def upsert(index: DataFrame, new: DataFrame, seq_col: str | None = None) -> DataFrame:
    """New entries replace stored ones with the same ID; within ``new`` the last write
    per ID wins (highest ``seq_col``)."""
    if seq_col is not None:
        w = Window.partitionBy("id").orderBy(F.col(seq_col).desc())
        new = new.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", seq_col)
    return index.join(new.select("id"), "id", "left_anti").unionByName(new.select(*index.columns))


def delete_ids(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Anti join on ID (an empty ID set is a no-op by construction)."""
    return index.join(ids.select("id"), "id", "left_anti")


def delete_rows(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Every entry of the given (table, pk) rows."""
    return index.join(keys.select(*KEY), KEY, "left_anti")


def replace_rows(index: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of rows being rebuilt are dropped (vectors too, a FIX), then the new ones added."""
    return delete_rows(index, new.select(*KEY).distinct()).unionByName(new.select(*index.columns))
