"""The registered queries over the test tables, the SQL of those that have one, the pipeline."""

import duckdb
import pytest
from llm_frames import documents, edge_rows, with_clashes

import __spark_entry__
import corpus_pipeline
from reelmart.llm.oracles import llm_oracles
from reelmart.llm.queries import llm_queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(llm_queries()))
def test_query_returns_whole_tables(spark, name):
    found = llm_queries()[name](spark, SF_DIR)
    table, key = {
        "op1_warc": ("pages", "page_id"),
        "op2_neighbours": ("embeddings", "vec_id"),
        "op9_html_text": ("pages", "page_id"),
        "op11_whitening": ("embeddings", "vec_id"),
    }.get(name, ("documents", "doc_id"))
    source = spark.read.parquet(f"{SF_DIR}/{table}.parquet")
    if name == "op2_neighbours":
        assert found.count() == 5 * source.where("vec_id % 50 = 0").count()
    elif name == "op11_whitening":
        assert found.count() == 16 * source.count()
    elif name == "op12_spelling_variants":
        assert found.count() == found.select("word").distinct().count() > 100
    elif name == "op13_best_fit_packing":
        assert found.where("piece = 0").count() == source.count()
    else:
        assert {r[key] for r in found.select(key).collect()} == {r[0] for r in source.select(key).collect()}
        assert found.count() == source.count()


@pytest.mark.parametrize("name", list(llm_oracles()))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    cursor = con.execute(llm_oracles()[name])
    names = [d[0] for d in cursor.description]
    found = llm_queries()[name](spark, SF_DIR)
    assert sorted(names) == sorted(found.columns)
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r[c] for c in names) for r in found.collect()) == order(cursor.fetchall())


def test_native_queries_run_no_python(spark):
    for name in ("op3_mixing", "op5_decontamination"):
        plan = llm_queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_registered():
    assert set(llm_queries()) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(llm_oracles()) <= set(__spark_entry__.oracle_sql())


def test_stages_keep_columns_and_clean_documents(spark):
    docs = documents(spark)
    for table in (docs, with_clashes(docs), documents(spark, [])):
        kept = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            found = corpus_pipeline.written(stage(spark, kept, SF_DIR))
            assert found.columns == table.columns
            assert found.count() <= kept.count()
            kept = found
        mix = corpus_pipeline.STAGES[-1][1](spark, kept, SF_DIR)
        assert mix.count() == kept.count()
    gone = {r[0] for r in edge_rows()} - {r.doc_id for r in documents(spark).collect()}
    assert not gone


def test_pipeline_decisions(spark):
    """What each stage does to rows whose fate is known."""
    draw_text = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first().text
    rows = [r for r in edge_rows() if r[0] is not None]
    rows += [(200, draw_text, "aa", "s1", 0), (201, 'x y token = "' + "ab12" * 10 + '" z', "aa", "s1", 0)]
    kept = documents(spark, rows)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, kept, SF_DIR))
        seen[name] = {r.doc_id: r for r in kept.collect()}
    assert not {5, 6, 7, 8, 14} & set(seen["language_id"]) and {9, 10, 15} <= set(seen["language_id"])
    assert not {2, 3, 4} & set(seen["near_duplicates"]) and {1, 200} <= set(seen["near_duplicates"])
    assert 200 not in seen["decontamination"] and {1, 9, 201} <= set(seen["decontamination"])
    assert seen["secret_scan"][201].text == 'x y [SECRET]" z' and seen["secret_scan"][201].n_chars == 15
    assert seen["secret_scan"][1].text == seen["decontamination"][1].text


def test_pipeline_runs(spark):
    found = corpus_pipeline.run(spark, SF_DIR)
    assert found.count() == len({r.doc_id for r in found.collect()}) > 100
    sources = {r.source: r for r in found.collect()}
    assert all(r.target <= 3 * r.source_size for r in sources.values())


def test_pipeline_returns_identified_languages(spark):
    rows = [(*r[:2], None if r[0] in (9, 11) else r[2], *r[3:]) for r in edge_rows() if r[0] is not None]
    kept = documents(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, kept, SF_DIR))
    mix = corpus_pipeline.STAGES[-1][1](spark, kept, SF_DIR)
    found = {r.doc_id: r.lang for r in mix.collect()}
    assert (found[1], found[9], found[10], found[11]) == ("aa", "aa", "bb", "bb")
