import brute
import corpus_pipeline
import pytest

from lecturelake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages_in_order_and_columns(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram jaccard join", "benchmark decontamination", "sentencepiece encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_match_brute_force(spark, docs):
    pairs = rows(docs)
    kept = {d for d, _, _, k, _ in brute.exact(pairs) if k}
    assert rows(corpus_pipeline.without_copies(spark, docs, SF)) == [x for x in pairs if x[0] in kept]
    groups = {d: c for d, _, c in brute.near(pairs, 5, 80, 100)}
    assert rows(corpus_pipeline.without_near_copies(spark, docs, SF)) == [x for x in pairs if groups[x[0]] == x[0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {x[0] for x in brute.phrases(pairs, items) if x[5]}
    assert dirty and rows(corpus_pipeline.without_benchmark(spark, docs, SF)) == [x for x in pairs if x[0] not in dirty]


def test_quality_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.good_quality(spark, docs, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    good, bad = [d for d, q in truth.items() if q], [d for d, q in truth.items() if not q]
    assert sum(d in kept for d in good) / len(good) > 0.97 and sum(d in kept for d in bad) / len(bad) < 0.2


def test_run_encodes_what_is_left(spark, docs):
    out = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(out) < docs.count() and all(r.round_trip for r in out)


def test_queries_are_registered():
    names = set(queries.QUERIES)
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and set(queries.ORACLE_SQL) <= names
