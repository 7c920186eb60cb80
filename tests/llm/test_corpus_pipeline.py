import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from langweave.llm.exact_dedup import exact_dedup
from langweave.llm.personal_data import personal_data
from langweave.llm.quality_rules import quality_rules
from langweave.llm.simhash import simhash_groups
from tools.check_oracle import canonical, duck

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered():
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality_rules" and len(corpus_pipeline.STAGES) == 5
    numbers = {int(m[1]) for q in entry.queries() if (m := re.match(r"op(\d+)_", q))}
    assert numbers == set(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(set(entry.LLM_ORACLES)))
def test_queries_equal_their_sql(spark, name):
    con = duck(SMALL)
    got, want = entry.queries()[name](spark, SMALL).toPandas(), con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_each_stage_judges_its_own_input(spark, tmp_path):
    """Stage by stage against the decisions of its operator."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        given = {r.doc_id: r.text for r in docs.collect()}
        if k < 4:
            assert out.columns == COLUMNS and len(ids) == out.count()
        if name == "quality_rules":
            labels = spark.read.parquet(f"{SMALL}/labels.parquet")
            assert ids == {r.doc_id for r in quality_rules(docs, labels).filter("kept").collect()}
            good = {r.doc_id for r in labels.filter("quality = 1").collect() if len(given.get(r.doc_id, "").split()) >= 20}
            assert len(good - ids) <= 0.01 * len(good)
        elif name == "exact_dedup":
            assert ids == {r.keep_id for r in exact_dedup(docs).collect()} < set(given)
        elif name == "simhash_near_dedup":
            assert ids == {r.component_id for r in simhash_groups(docs).collect()}
        elif name == "personal_data":
            assert ids == set(given)
            touched = {r.doc_id for r in personal_data(docs).filter("size(spans) > 0").collect()}
            for r in out.collect():
                assert (r.text != given[r.doc_id]) == (r.doc_id in touched) and r.n_chars == len(r.text)
                assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)
        else:
            assert ids == set(given)
            assert out.selectExpr("sum(n_tokens) as n").first().n == sum(len(t.encode()) + 1 for t in given.values())
        docs = out
    whole = corpus_pipeline.run(spark, SMALL)
    assert canonical(whole.toPandas()) == canonical(docs.toPandas())
