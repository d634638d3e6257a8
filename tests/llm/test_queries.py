"""The registered queries and the pipeline."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from ledgerlens.llm import bag_minhash, decontaminate, hd_language, oracle, rule_ensemble
from ledgerlens.llm.common import frozen, read_table

SF = "/root/testdata/sf0.001"


def test_queries_and_the_pipeline_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    as_rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df[columns].astype(object).itertuples(index=False))
    assert as_rows(got) == as_rows(want)


def test_pipeline_stages_follow_their_rules(spark):
    docs = read_table(spark, SF, "documents")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "quality", "near_duplicates", "decontamination", "packing"]
    new = frozen(stages["language_id"](spark, docs, SF), "t")
    assert new.columns == docs.columns and ids(new) == ids(hd_language.identify(docs).where("lang_pred <> 'und'"))
    old, new = new, frozen(stages["quality"](spark, new, SF), "t")
    assert new.columns == docs.columns and ids(new) == ids(rule_ensemble.classify(old, read_table(spark, SF, "labels")).where("predicted = 1"))
    old, new = new, frozen(stages["near_duplicates"](spark, new, SF), "t")
    assert new.columns == docs.columns and ids(new) == ids(bag_minhash.near_duplicates(old).where("kept"))
    old, new = new, frozen(stages["decontamination"](spark, new, SF), "t")
    assert new.columns == docs.columns and ids(new) == ids(decontaminate.decontaminate(old, read_table(spark, SF, "benchmark")).where("not contaminated"))
    last = corpus_pipeline.run(spark, SF)
    assert ids(last.where("start = 0")) == ids(new)
    assert last.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
