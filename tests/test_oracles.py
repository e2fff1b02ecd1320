"""Queries against their SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidemark import plans

SF = "/root/testdata/sf0.001"
NAMES = [
    "p01_repository_from_url", "p02_p03_normalized_repository", "p05_p06_p07_paths", "p09_p10_lenient_numbers", "p11_p12_p13_priority", "p20_text_features", "f02_first_of_key", "f06_candidate_filter", "j01_f03_exclusion_ledger",
    "w1_walk_forward", "w2_j04_j06_manifest", "a06_a14_numeric_profile", "a09_coverage", "a12_j09_correlations", "v01_v02_v03_v04_split_metrics", "v09_wilcoxon", "v10_f09_split_reliability", "m01_oversampling", "m02_m04_fitted_features", "m03_min_max_tests", "s01_inferred_types",
    "s01_s11_csv_round_trip", "s02_text_rows", "s08_union_of_files", "s10_path_candidates", "s14_ordered_rebuild", "f05_common_valid_samples", "f07_f08_repository_size_filter", "f10_feature_families", "p14_selection_reason", "p15_p16_row_status", "w08_repositories_without_graph",
    "a02_label_summary", "a05_temporal_summary", "a05_years", "a09_coverage_by_metrics", "a10_usable_graphs_by_file", "a11_leakage", "a12_strong_pairs", "a18_j07_threshold_grid", "j08_threshold_join", "v07_every_score", "v09_wilcoxon_of_few", "m07_naive_bayes_by_prefix_sums",
    "s05_graphml_edges", "g09_g10_node_features", "g12_edge_type_distribution", "g13_graph_sample_reasons", "g15_relation_means", "g15_gin_two_hops", "w03_average_rank",
    "g04_direct_fans", "g06_global_ends", "g07_lack_of_cohesion", "g17_split_scales", "v14_benchmark_levels", "g15_gcn", "s05_graphml_source", "s06_s07_dot_source",
]


def text(x):
    if x is None or x != x:
        return None
    return f"{x:.7g}" if isinstance(x, float) else x.isoformat() if hasattr(x, "isoformat") else str(x)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([text(r[i]) for i in order] for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df, sql = plans.QUERIES[name](spark, SF), duck.sql(plans.ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert canon(df.columns, df.collect()) == canon(sql.columns, sql.fetchall())


def test_every_oracle_has_a_query():
    assert set(plans.ORACLES) <= set(plans.QUERIES)
