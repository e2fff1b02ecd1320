"""Decisions over rows, each the first reason that holds: extraction status, repository candidates, valid samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.operators.audit import all_reasons, first_reason


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def quality_error(nodes: Column, edges: Column, placeholder: Column, min_nodes: int, min_edges: int) -> Column:
    """Why a graph is of low quality: a placeholder, too few nodes, too few edges; else null."""
    few = lambda what, n, least: F.when(n < least, F.concat(F.lit(f"{what} below minimum threshold: "), n.cast("string"), F.lit(f" < {least}")))
    return F.coalesce(F.when(placeholder, "unresolved include/import placeholder graph"), few("nodes", nodes, min_nodes), few("edges", edges, min_edges))


def row_status(df: DataFrame, *, min_nodes: int = 3, min_edges: int = 2) -> DataFrame:
    """df (repository, commit, filepath, parse_error, nodes, edges, placeholder) with status and error."""
    safe = s.safe_path(F.col("filepath"))
    kind, quality = s.unsupported_reason(safe), quality_error(F.col("nodes"), F.col("edges"), F.coalesce("placeholder", F.lit(False)), min_nodes, min_edges)
    rules = [
        (blank(F.col("repository")) | blank(F.col("commit")) | blank(F.col("filepath")), "MISSING_REQUIRED_FIELD", F.lit("repository/commit/filepath")),
        (safe.isNull() | (safe == ""), "INVALID_FILEPATH", F.col("filepath")), (kind != "", "UNSUPPORTED_FILE_TYPE", kind),
        (F.col("parse_error").isNotNull(), "GRAPH_PARSE_FAILURE", s.short_error(F.col("parse_error"))), ((F.col("nodes") == 0) | (F.col("edges") == 0), "EMPTY_GRAPH", F.lit("")),
        (quality.isNotNull(), "LOW_QUALITY_GRAPH", quality),
    ]
    error = F.lit("")
    for condition, _, said in reversed(rules):
        error = F.when(condition, said).otherwise(error)
    return df.withColumns({"status": first_reason([r[:2] for r in rules], F.lit("SUCCESS")), "error": error})


def candidate_outcomes(df: DataFrame, order: str, min_stars: int) -> DataFrame:
    """df (full_name, archived, disabled, stars, url, default_branch, tutorial, signal) with outcome.

    Only an accepted repository makes later rows of its name, in order, duplicates, whatever else speaks against them."""
    name, bad = F.lower("full_name"), "missing or invalid metadata"
    why = first_reason([
        (blank(name), bad), (F.coalesce("archived", F.lit(False)), "archived repository"), (F.coalesce("disabled", F.lit(False)), "disabled repository"),
        (F.coalesce("stars", F.lit(0)) < min_stars, "below minimum stars"), (blank(F.col("url")) | blank(F.col("default_branch")), bad),
        (F.col("tutorial"), "likely tutorial"), (~F.col("signal"), "no signal"),
    ])
    rows = df.withColumns({"_name": name, "_why": why})
    first = rows.where("_why IS NULL").groupBy("_name").agg(F.min(order).alias("_first"))
    outcome = F.when(F.col("_first") < F.col(order), "duplicate repository").otherwise(F.coalesce("_why", F.lit("accepted")))
    return rows.join(first, "_name", "left").withColumn("outcome", outcome).drop("_name", "_why", "_first")


def size_reasons(df: DataFrame, *, rows: int, positives: int, negatives: int, tags: int) -> DataFrame:
    """df (status, n, pos, tags) with reasons: all that speak against a repository, status first."""
    n, pos = F.col("n"), F.col("pos")
    return df.withColumn("reasons", all_reasons([(F.coalesce("status", F.lit("")) != "SUCCESS", "status_not_success"), (n < rows, "rows"), (pos < positives, "positives"), (n - pos < negatives, "negatives"), (F.col("tags") < tags, "tags")]))


def valid_sample_reason(metrics: list[str], path_known: Column, *, min_nodes: int = 3, min_edges: int = 2) -> Column:
    """Why a sample is not valid for all experiments: nodes, edges, a missing metric, no graph file; else null."""
    missing = F.lit(False)
    for m in metrics:
        missing = missing | F.col(m).isNull()
    return first_reason([
        (F.coalesce(F.col("nodes") < min_nodes, F.lit(True)), f"below_min_nodes_{min_nodes}"), (F.coalesce(F.col("edges") < min_edges, F.lit(True)), f"below_min_edges_{min_edges}"),
        (missing, "missing_metric"), (~F.coalesce(path_known, F.lit(False)), "graph_path_missing"),
    ])


def resolved_paths(rows: DataFrame, files: DataFrame, base: str, *, path: str = "path", mark: str = "/app/output/") -> DataFrame:
    """rows with found: the first of a path's candidates that is among files (one column): the path itself, what
    follows mark under base, its last part under base, and, where it is relative, itself under base; else null."""
    text = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    under = lambda c: F.concat(F.lit(f"{base}/"), c)
    rest = F.when(F.instr(text, mark) > 0, under(F.substr(text, F.instr(text, mark) + len(mark))))
    relative = F.when(~text.startswith("/"), under(text))
    each = F.array(F.col(path), rest, under(F.substring_index(text, "/", -1)), relative)
    asked = rows.select(path).where(~blank(F.col(path))).distinct().select(path, F.posexplode(each).alias("_at", "_file")).where("_file IS NOT NULL")
    known = files.select(F.col(files.columns[0]).alias("_file")).distinct()
    hits = asked.join(known, "_file").groupBy(path).agg(F.min(F.struct("_at", "_file"))["_file"].alias("found"))
    return rows.join(hits, path, "left")
