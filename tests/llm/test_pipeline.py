import subprocess
import sys

from corpus import awkward, empty, sha
from pyspark.sql import functions as F

import corpus_pipeline as C
from lexivec.llm.common import save

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in C.STAGES[:-1]:
        docs = save(stage(spark, docs, SF), name)
        assert docs.columns == columns, name
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    language, lines, near, mixed = kept
    assert language == lines and near <= lines and mixed <= near
    want = sorted((r.doc_id, sha(r.text)) for r in docs.collect())
    from lexivec.llm.bpe import decode_documents, read_spec
    from lexivec.llm.queries import tokenizer_path

    got = decode_documents(C.run(spark, SF), read_spec(tokenizer_path("byte_bpe_50k.json")))
    assert sorted((r.doc_id, sha(r.decoded)) for r in got.collect()) == want


def test_awkward_documents_and_empty_tables(spark):
    docs = awkward(spark, ["score", "fp", "n_lines", "size", "a.b"])
    nothing = empty(spark).withColumn("a.b", F.lit("x"))
    for name, stage in C.STAGES:
        out = save(stage(spark, docs, SF), name)
        assert out.columns == docs.columns or name == "bpe_encode"
        left = save(stage(spark, nothing, SF), name)
        assert left.count() == 0
        docs = out if name != "bpe_encode" else docs
    rows = out.collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(".", copy, ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
