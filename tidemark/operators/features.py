"""Which columns are features, of which family, by name and by whether anything in them is a number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: columns that are no features, graph metrics and what belongs to them, families of feature names and their other names
ID_COLUMNS = "repo_url branch repository commit committed_at filepath row_index status error _merge graphml_path graphml_local_path dataset_id dataset_version pdg_metric_semantics pdg_quality_min_nodes pdg_quality_min_edges _sample_id".split()
LABEL_COLUMNS = ["failure_prone"]
GRAPH_METRICS = "maxPdgVertices lackOfCohesion verticesCount edgesCount edgesToVerticesRatio globalInput globalOutput directFanIn indirectFanIn directFanOut indirectFanOut".split()
GRAPH_EXTRAS = "nodes edges pdg_task_nodes pdg_order_edges pdg_def_edges pdg_use_edges pdg_unique_edge_labels".split()
TOP4 = "maxPdgVertices verticesCount edgesToVerticesRatio edgesCount".split()
METRIC_SETS = {"all": GRAPH_METRICS, "top4": TOP4, "iuliano_top4": TOP4, "best_pdg": TOP4, "top5": [*TOP4, "globalInput"]}
FAMILIES = {
    "process": "additions additions_avg additions_max change_set_avg change_set_max code_churn_avg code_churn_count code_churn_max commits_count contributors_count deletions deletions_avg deletions_max highest_contributor_experience hunks_median minor_contributors_count".split(),
    "product": "lines_blank lines_code lines_comment num_conditions num_decisions num_keys num_parameters num_paths num_tokens num_vars text_entropy".split(),
    "iac_oriented": (
        "avg_play_size avg_task_size num_authorized_key num_block_error_handling num_blocks num_commands num_deprecated_keywords num_deprecated_modules num_distinct_modules num_external_modules num_fact_modules num_file_exists "
        "num_file_mode num_file_modules num_filters num_ignore_errors num_import_playbook num_import_role num_import_tasks num_include num_include_role num_include_tasks num_include_vars num_lookups num_loops num_math_operations "
        "num_names_with_vars num_plays num_prompts num_regex num_roles num_suspicious_comments num_tasks num_unique_names num_uri"
    ).split(),
}
ALIASES = {"process": "process", "processo": "process", "product": "product", "prodotto": "product", "iac": "iac_oriented", "iac_oriented": "iac_oriented", "iac-oriented": "iac_oriented", "delta": "delta"}


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns, in order, in which anything is a number: one aggregate over df. Ids and labels are none."""
    asked = [c for c in df.columns if c not in ID_COLUMNS and c not in LABEL_COLUMNS]
    if not asked:
        return []
    found = df.agg(*(F.count(F.col(f"`{c}`").cast("string").try_cast("double")).alias(str(i)) for i, c in enumerate(asked))).first()
    return [c for i, c in enumerate(asked) if found[i]]


def tabular_features(numeric: list[str]) -> list[str]:
    return [c for c in numeric if c not in GRAPH_METRICS and c not in GRAPH_EXTRAS]


def families(numeric: list[str]) -> dict[str, list[str]]:
    """Features of each family, and those named delta_."""
    have = tabular_features(numeric)
    out = {family: [c for c in names if c in have] for family, names in FAMILIES.items()}
    return out | {"delta": sorted(c for c in have if c.startswith("delta_"))}


def family(numeric: list[str], name: str) -> list[str]:
    known = ALIASES.get(name.strip().lower())
    if known is None:
        raise ValueError(f"unknown family {name}, one of {', '.join(sorted(ALIASES))}")
    return families(numeric)[known]


def unmapped(numeric: list[str]) -> list[str]:
    mapped = {c for names in families(numeric).values() for c in names}
    return sorted(set(tabular_features(numeric)) - mapped)


def graph_metrics(wanted: str | list[str] = "all") -> list[str]:
    """A set by name, or metrics by name, comma-separated or as a list."""
    if isinstance(wanted, str):
        if wanted.lower() in METRIC_SETS:
            return list(METRIC_SETS[wanted.lower()])
        wanted = [x.strip() for x in wanted.split(",") if x.strip()]
    if unknown := [x for x in wanted if x not in GRAPH_METRICS]:
        raise ValueError(f"unknown graph metrics: {unknown}")
    return list(wanted)


def combined_features(numeric: list[str], metrics: str | list[str] = "all", only_graph: bool = False) -> list[str]:
    """Tabular features and graph metrics, or the latter alone."""
    chosen, base = graph_metrics(metrics), [] if only_graph else tabular_features(numeric)
    return base + [c for c in chosen if c not in base]
