"""URL filters by a temporal list join.

Dated list entries (a pattern is added or removed on a day) become validity intervals of their
pattern; an as-of join finds, for every capture, the entries that were active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import others
from tidemark.shared import stored

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Host in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def parts_of(path: Column) -> Column:
    """The parts of a path, each up to its slash or the end."""
    return F.filter(F.regexp_extract_all(path, F.lit(r"[^/]*/?"), F.lit(0)), lambda x: x != "")


def depths(lists: DataFrame) -> tuple[list[int], list[int]]:
    """How many labels the domains and how many parts the paths of a list have: the distinct numbers,
    to the driver. There are as many as the longest pattern has parts, at most."""
    host, path = F.substring_index("pattern", "/", 1), F.substr("pattern", F.instr("pattern", "/"))
    deep = F.when(F.instr("pattern", "/") > 0, F.size(parts_of(path))).otherwise(-F.size(F.split(host, r"\.")))
    found = sorted(r[0] for r in lists.select(deep.alias("deep")).distinct().collect())
    return [-n for n in found if n < 0], [n for n in found if n > 0]


def patterns_of(url: Column, domains: list[int], paths: list[int]) -> Column:
    """What an entry may say to match the URL: the host and its parent domains (of two labels and
    more), and the host with each leading part of the path that ends in a slash or at its end. Only
    domains of so many labels and paths of so many parts as are asked for are spelt out."""
    labels, parts = F.split(host_of(url), r"\."), parts_of(F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1))
    have, none = F.size(labels), F.array().cast("array<string>")
    allowed = lambda n: (n <= have) & ((n > 1) | (have == 1))
    hosts = F.transform(F.filter(F.array(*map(F.lit, domains)), allowed), lambda n: F.array_join(F.slice(labels, have - n + 1, n), ".")) if domains else none
    fit = F.filter(F.array(*map(F.lit, paths)), lambda n: n <= F.size(parts)) if paths else F.array().cast("array<int>")
    tails = F.transform(fit, lambda n: F.concat(host_of(url), F.array_join(F.slice(parts, F.lit(1), n), "")))
    return F.when(host_of(url) == "", none).otherwise(F.array_distinct(F.concat(hosts, tails)))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, valid_from, valid_to) from entries (pattern, category, listed_at, listed).

    An entry holds from its date until the next one of its pattern; of several on a date the removal
    holds. Entries without a pattern, category or date hold never. Adding again changes nothing but
    the category. valid_to is null for what still holds.
    """
    days = entries.where("pattern IS NOT NULL AND category IS NOT NULL AND listed_at IS NOT NULL")
    days = days.groupBy("pattern", "listed_at").agg(F.bool_and(F.coalesce("listed", F.lit(False))).alias("listed"), F.min("category").alias("category"))
    until = F.lead("listed_at").over(Window.partitionBy("pattern").orderBy("listed_at"))
    return days.withColumn("valid_to", until).where("listed").select("pattern", "category", F.col("listed_at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """captures with url_host, n_active (entries active at fetch time), blocked, matched and category
    (of the longest matching pattern; ties by code point).

    Every capture is kept, repeated rows too. A null URL, one without a host, or a null fetch time
    matches nothing. Without entries nothing is blocked. Columns of captures named as the results are
    replaced. URLs may be of any length: only what can be in the list is spelt out. Verdicts are made once for each distinct (URL, time): a URL that holds a third of all
    rows is one row there; the join back may be split by its left side, as the join with the list.
    """
    names = ["url_host", "n_active", "blocked", "matched", "category"]
    rows = captures.select(F.struct(*others(captures, names)).alias("_row"), F.col(url_col).alias("_url"), F.col(time_col).alias("_at"))
    asked = rows.select("_url", "_at").where("_url IS NOT NULL AND _at IS NOT NULL").distinct()
    lists = stored(intervals(entries))
    asked = asked.select("_url", "_at", F.explode(patterns_of(F.col("_url"), *depths(lists))).alias("pattern"))
    active = (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    hits = asked.join(lists, (asked["pattern"] == lists["pattern"]) & active).select("_url", "_at", asked["pattern"], "category")
    best = F.max(F.struct(F.length("pattern").alias("size"), "pattern", "category"))
    found = hits.groupBy("_url", "_at").agg(F.count("*").alias("_n"), best.alias("_best")).withColumnsRenamed({"_url": "_u", "_at": "_t"})
    out = rows.join(found, (rows["_url"] == found["_u"]) & (rows["_at"] == found["_t"]), "left")
    return out.select(
        "_row.*", host_of(F.col("_url")).alias("url_host"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_active"),
        F.col("_n").isNotNull().alias("blocked"), F.col("_best.pattern").alias("matched"), F.col("_best.category").alias("category"),
    )
