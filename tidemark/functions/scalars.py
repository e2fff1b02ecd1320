"""Column expressions: identifiers, paths, lenient numbers, scores, node and edge text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that mark teaching material, and words that mark the subject
EXCLUDED_WORDS = ("awesome", "tutorial", "example", "examples", "sample", "samples", "workshop", "course", "exercise", "exercises", "interview", "interview-questions", "training", "cheatsheet", "cheat-sheet", "demo", "learn", "learning", "guide", "handbook")
SIGNAL_WORDS = ("ansible", "ansible-role", "ansible role", "ansible-collection", "ansible collection", "playbook", "molecule")
# fixed values: node categories in one-hot order
NODE_TYPES = ("Task", "Operator", "Condition", "Data", "Variable", "Function", "Module", "Call", "Expression", "Assignment", "Unknown")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Does the lower-case text hold any of the words."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def repository_from_url(url: Column) -> Column:
    """owner/name: what follows github.com/, else the last two parts of the path."""
    t = F.regexp_replace(F.regexp_replace(F.replace(F.trim(url), F.lit("\\"), F.lit("/")), "/+$", ""), r"\.git$", "")
    parts = F.filter(F.split(t, "/"), lambda x: x != "")
    last = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")
    return F.when(F.contains(t, F.lit("github.com/")), F.substring_index(t, "github.com/", -1)).otherwise(last)


def normalized_repository(name: Column) -> Column:
    t = F.replace(F.trim(name), F.lit("\\"), F.lit("/"))
    t = F.regexp_replace(t, r"(?i)^(https?://github\.com/|git@github\.com:)", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "/+$", ""), r"\.git$", ""), "^/+|/+$", "")


def clone_url(url: Column, repository: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(url), F.lit("")), F.concat(F.lit("https://github.com/"), repository, F.lit(".git")))


def key_text(c: Column) -> Column:
    """Trimmed text of a key; null stays null."""
    return F.trim(c.cast("string"))


def safe_path(path: Column) -> Column:
    """A relative path without parent steps, interior single dots and double slashes collapsed; else null."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    bad = path.isNull() | path.startswith("/") | path.startswith("\\") | F.array_contains(parts, "..")
    return F.when(~bad, F.array_join(parts, "/"))


def unsupported_reason(path: Column) -> Column:
    parts = F.split(path, "/")
    out = F.lit("")
    for name in ("defaults", "vars", "handlers", "meta"):
        out = F.when(F.array_contains(parts, name), F.lit(f"{name} file")).otherwise(out)
    return out


def wraps_tasks(path: Column) -> Column:
    return F.array_contains(F.split(path, "/"), "tasks")


def safe_component(c: Column) -> Column:
    t = F.regexp_replace(F.trim(c), "[^A-Za-z0-9_.-]+", "_")
    return F.when(t == "", F.lit("unknown")).otherwise(t)


def slug(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}]", "_"), 1, 80)


def short_error(c: Column, limit: int = 500) -> Column:
    """The last line that is not blank, trimmed and cut."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.substring(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")), 1, limit)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def finite(c: Column) -> Column:
    """The number, or null where it is no finite number."""
    x = c.cast("string").try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def int_or_zero(c: Column) -> Column:
    return F.coalesce(finite(c).cast("long"), F.lit(0))


def label01(c: Column) -> Column:
    x = c.cast("string").try_cast("double")
    return F.when(x == 0, 0).when(x == 1, 1).when(F.lower(c.cast("string")) == "true", 1).when(F.lower(c.cast("string")) == "false", 0)


def days_since(at: Column, now: Column) -> Column:
    return F.coalesce(F.greatest(F.datediff(now, at), F.lit(0)), F.lit(3650))


def priority(stars: Column, forks: Column, queries: Column, days: Column, signal: Column, topics: Column) -> Column:
    topical = F.exists(topics, lambda t: F.lower(t).startswith("ansible"))
    recent = F.greatest(F.lit(3650) - days, F.lit(0)) / 3650.0
    score = F.least(stars, F.lit(5000)) * 1.0 + F.least(forks, F.lit(1000)) * 0.5 + queries * 100.0 + recent * 250.0
    return F.bround(score + F.when(signal, 250.0).otherwise(0.0) + F.when(topical, 200.0).otherwise(0.0), 3)


def selection_reason(matched: Column, topics: Column, blob: Column) -> Column:
    """Why a repository was taken: what matched, then what it says of itself, each reason once, in this order."""
    said = [
        F.when(F.exists(topics, lambda t: F.lower(t).startswith("ansible")), "repository has ansible-related topics"),
        F.when(any_of(blob, ("ansible-role", "ansible role")), "name/description contains ansible-role"),
        F.when(any_of(blob, ("ansible-collection", "ansible collection")), "repository appears to be an Ansible collection"),
        F.lit("passed minimum stars and activity filters"), F.lit("default branch detected from GitHub metadata"),
    ]
    return F.array_join(F.array_distinct(F.concat(matched, F.array_compact(F.array(*said)))), "; ")


def bucket(value: Column, edges: list[float]) -> Column:
    """Right-closed bins, the lowest edge included: (a, b] as text, null outside."""
    out = F.lit(None).cast("string")
    for i in range(len(edges) - 1, 0, -1):
        low = value >= edges[0] if i == 1 else value > edges[i - 1]
        out = F.when(low & (value <= edges[i]), F.lit(f"({edges[i - 1]:g}, {edges[i]:g}]")).otherwise(out)
    return out


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def text_tokens(label: Column) -> Column:
    return F.regexp_extract_all(label, F.lit(r"(?U)\w+|\{\{.*?\}\}"), F.lit(0))


def text_features(label: Column) -> dict[str, Column]:
    tokens = text_tokens(label)
    n = F.size(tokens)
    numeric = F.size(F.filter(tokens, lambda t: t.rlike("[0-9]")))
    return {
        "label_length": F.length(label).cast("double"), "token_count": n.cast("double"),
        "numeric_fraction": F.when(n > 0, numeric / n).otherwise(0.0),
        "has_template": (F.contains(label, F.lit("{{")) & F.contains(label, F.lit("}}"))).cast("double"),
        "has_equals": F.contains(label, F.lit("=")).cast("double"),
    }


def first_attr(attrs: Column, *names: str) -> Column:
    return F.coalesce(*(F.nullif(F.try_element_at(attrs, F.lit(n)), F.lit("")) for n in names))


def node_type(attrs: Column) -> Column:
    raw = F.trim(first_attr(attrs, "node_type", "type", "kind", "label"))
    word, low = F.initcap(F.element_at(F.split(raw, r"\s+"), 1)), F.lower(raw)
    return (
        F.when(raw.isNull() | (raw == ""), "Unknown").when(raw.isin(*NODE_TYPES), raw).when(word.isin(*NODE_TYPES), word)
        .when(any_of(low, ("task",)), "Task").when(any_of(low, ("operator",)), "Operator")
        .when(any_of(low, ("condition", "guard")), "Condition").when(any_of(low, ("data", "input", "output")), "Data").otherwise("Unknown")
    )


def edge_type(attrs: Column) -> Column:
    """0 other, 1 data, 2 control, 3 depends, 4 guard or condition, 6 task; the first of control, data, depends, guard, task."""
    names = ("type", "edge_type", "kind", "label", "relation", "flow", "type_label")
    text = F.lower(F.concat_ws(" ", *(F.try_element_at(attrs, F.lit(n)) for n in names)))
    has = lambda *w: any_of(text, w)
    return F.when(has("control"), 2).when(has("data"), 1).when(has("depend"), 3).when(has("guard", "condition"), 4).when(has("task"), 6).otherwise(0)


def clean_label(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(label, r"^\s+|\s+$", ""), '^"+|"+$', "")


def is_task_node(attrs: Column) -> Column:
    """Task by shape or markup: not the same test as node_type's."""
    label = F.coalesce(F.try_element_at(attrs, F.lit("label")), F.lit(""))
    return (F.coalesce(F.try_element_at(attrs, F.lit("shape")), F.lit("")) == "ellipse") | F.contains(label, F.lit("<B>"))
