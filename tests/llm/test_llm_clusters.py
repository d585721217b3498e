"""Operators on a master other than local, with a scratch folder that all its machines see."""

import pytest

from reelmart import scratch
from reelmart.llm.queries import llm_queries

SF_DIR = "/root/testdata/sf0.001"
# Each writes scratch tables or files.
WRITING = (
    "op1_warc op2_neighbours op3_mixing op5_decontamination op6_substring_dedup op7_secret_scan "
    "op10_near_duplicates op11_whitening op12_spelling_variants op13_best_fit_packing"
).split()


@pytest.mark.parametrize("name", WRITING)
def test_query_runs_on_a_cluster_with_a_mounted_folder(spark, monkeypatch, name):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(scratch, "_shared_roots", set(), raising=False)
    assert llm_queries()[name](spark, SF_DIR).count() > 0
