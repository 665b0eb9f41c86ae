"""The registered queries against their SQL, and the pipeline against a plain run."""

import corpus_pipeline
import oracle
import pytest
from messy import SCHEMA, empty, messy
from test_dedup import digest, exact_truth, near_truth
from test_rules import LABELS, base_truth, labels, llr_truth
from test_tokens import check_packing

from tidemill.llm.queries import QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle.connect(sf_dir)


def test_all_operators_are_registered():
    import __spark_entry__

    names = {name.split("_")[0] for name in QUERIES}
    assert names == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_agrees_with_sql(spark, sf_dir, connection, name):
    query = QUERIES[name]
    assert oracle.difference(query.run(spark, sf_dir), connection, query.sql) is None


def test_shards_of_documents_are_nearly_equal_in_bytes(spark, sf_dir):
    rows = QUERIES["op5_sharding"].run(spark, sf_dir).collect()
    sizes = {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert set(sizes) == set(range(16)) and max(sizes.values()) < 1.01 * min(sizes.values())


def kept_by_brute_force(rows, trusted):
    good = []
    for (i, text), (_, passes) in zip(rows, llr_truth(rows, trusted), strict=True):
        base = base_truth(text)
        if passes and not (base[0] < 10 or 100 * base[4] > 20 * base[0]):
            good.append((i, text))
    keepers, seen, exact = exact_truth(good), set(), []
    for i, text in sorted(good, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0)):
        d = digest(text)
        if d not in seen and keepers[d][0] == i:
            seen.add(d)
            exact.append((i, text))
    roots = set(near_truth(exact).values())
    return [(i, t) for i, t in exact if i is None or i in roots]


def test_pipeline_on_messy_rows(spark, tmp_path):
    docs, (given, trusted) = messy(spark), labels(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    given.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    truth = kept_by_brute_force(rows, trusted)
    check_packing(got, truth)
    assert {r.doc_id for r in got} == {i for i, _ in truth}


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    nothing = empty(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing, str(tmp_path)).schema == nothing.schema
        assert stage(spark, nothing, str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, str(tmp_path)).count() == 0
    assert messy(spark).schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()


def test_pipeline_keeps_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, sf_dir).select("doc_id").collect()}
    given = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    passed = {1: [], 0: []}
    for r in docs.select("doc_id", "text").collect():
        base = base_truth(r.text)
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        assert not (failed and r.doc_id in kept)
        if not failed and r.doc_id in given:
            passed[given[r.doc_id]].append(r.doc_id in kept)
    assert sum(passed[1]) >= 0.99 * len(passed[1])
    assert sum(passed[0]) <= 0.25 * len(passed[0])
