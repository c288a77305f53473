"""The registered queries against their SQL, and the pipeline stage by stage."""

import random

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from datalathe.llm import shingles
from datalathe.llm.common import map_arrow
from datalathe.llm.queries import ORACLES, QUERIES
from datalathe.session import cut_lineage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations", "labels", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found = QUERIES[name](spark, FOLDER)
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    show = lambda v: f"{v:.9f}" if isinstance(v, float) else str(v)
    expected = sorted(tuple(map(show, r)) for r in cursor.fetchall())
    assert sorted(tuple(map(show, r)) for r in found.select(*names).collect()) == expected


def test_all_operators_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > counts[2]
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, FOLDER)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept


def test_pipeline_on_awkward_rows(spark, corpus, nothing):
    for docs in (corpus, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER).cache()
        assert docs.count() >= 0


def test_a_stage_and_what_reads_its_rows_run_in_small_batches(spark, tmp_path):
    rnd = random.Random(5)
    texts = (rnd.randbytes(2000).hex(" ", 4) for _ in range(2500))
    docs = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in enumerate(texts)], SCHEMA).coalesce(1)
    settings = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize", "parquet.block.size"]
    before = {s: spark.conf.get(s, None) for s in settings}
    try:
        spark.conf.set(settings[1], 256)
        kept = corpus_pipeline.quality_rules(spark, docs, "")
        sizes = map_arrow(kept.select("doc_id"), lambda batches: ({"n": [b.num_rows]} for b in batches), "n int")
        found = [r["n"] for r in sizes.collect()]
        kept.write.parquet(str(tmp_path / "kept"))
        assert spark.conf.get(settings[1]) == "256", "a smaller setting stays"
    finally:
        for s, value in before.items():
            if value is None:
                spark.conf.unset(s)
            else:
                spark.conf.set(s, value)
    assert sum(found) == 2500 and max(found) <= 1000
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "kept").glob("*.parquet")]
    assert max(f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)) < 2500


def test_sets_that_are_not_there_need_no_python_rows(spark, corpus):
    rows = cut_lineage(corpus.select(F.monotonically_increasing_id().alias("number"), F.struct("*").alias("row")))
    sets = shingles._Sets(cut_lineage(shingles._with_sets(rows, "text", "row", 5, shingles.THRESHOLD)), "text", 5, shingles.THRESHOLD)
    assert sets.held.count() == 0 and sets.held.dtypes == [("node", "bigint"), ("set", "binary")]
    assert "ExistingRDD" not in sets.held._jdf.queryExecution().toString()
