"""Queries on a master other than local, with a scratch folder that all its machines see."""

import pytest

from reelmart import scratch
from testbed.catalogue import catalogue

SF_DIR = "/root/testdata/sf0.001"
# Each writes scratch tables or files.
WRITING = (
    "append_dim_devices csv_classified_reviews csv_column_kinds csv_inferred_purchases csv_large_files "
    "csv_movie_reviews csv_returns_and_blocks csv_review_logs csv_stray_quotes csv_user_purchase dim_location "
    "dim_location_by_ranges dim_devices dim_lookup_by_shuffle dim_lookup dim_os extend_dim_date "
    "extend_dim_location fact_movie_analytics fact_over_buckets fact_over_buckets_hot_users fact_prefiltered "
    "incremental_fact"
).split()


@pytest.mark.parametrize("name", WRITING)
def test_query_runs_on_a_cluster_with_a_mounted_folder(spark, monkeypatch, name):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(scratch, "_shared_roots", set(), raising=False)
    assert catalogue()[name](spark, SF_DIR).count() > 0
