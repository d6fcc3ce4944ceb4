"""URL filter with a path-template tree for each host: only DataFrame functions, no Python on executors.

Paths are reduced to shapes (numbers and long hexadecimal parts become marks), so that the tree is
grown over distinct shapes with counts. Branching by branching, children of a node that are rare become a
wildcard, and so do those whose continuation and label rate are like the node's as a whole. A
template is rejected if the share of its labelled pages that a rule blocks, smoothed by the share of blocked
ones among all pages of the host, and that by their share among all pages, passes a threshold.

What all shapes of a node have in common is passed at once, and nodes of few pages, in which any
difference merges, are finished at once. So any depth is grown to its end, in as many rounds as branchings of
larger nodes lie behind each other.
"""

from __future__ import annotations

import functools
import math
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eonmap.llm.common import hot_join, materialise

#: (verdict, host, path): a rule fits its host and all subdomains and every path that starts with its path.
Rule = tuple[str, str, str]
#: A child with a smaller share of its node's pages is variable.
MIN_SHARE = 0.02
#: Children are alike if the total variation of what follows, and their label rates, differ by less.
LIKE = 0.2
#: Pages that the rate above a template or host counts for; the rate from which a template is rejected.
WEIGHT, REJECT = 10.0, 0.5
#: Finished parts of the tree after which they are written together, so that plans stay short.
PARTS = 30
WILD = "*"
END = "$"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    has = F.coalesce(at, F.lit(0)) > 0
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.when(has, host).otherwise(""), F.when(has, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, null without one."""
    found: Column = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(found)
    return found.cast("struct<verdict:string,rule:string>")


def shapes(path: Column) -> Column:
    """The segments of a path with numbers and long hexadecimal parts as marks."""
    marked = F.regexp_replace(F.regexp_replace(F.substr(path, F.lit(2)), r"(?i)(?<![0-9a-z])(?=[a-f-]*[0-9])[0-9a-f][0-9a-f-]{7,}(?![0-9a-z])", "{h}"), r"[0-9]+", "{n}")
    return F.split(marked, "/")


def _kind(segment: Column) -> Column:
    """What follows, in five kinds: 0 end, 1 empty, 2 number, 3 hexadecimal, 4 word."""
    return (F.when(segment.isNull(), 0).when(segment == "", 1).when(F.contains(segment, F.lit("{n}")), 2)
            .when(F.contains(segment, F.lit("{h}")), 3).otherwise(4))


KINDS = range(5)


def few(like: float) -> int:
    """Pages up to which the counts of a node can't tell any two of its children apart."""
    if not 0 <= like < 1:
        raise ValueError("like must lie from 0 to below 1")
    # the slack, like + 1 / sqrt(n) + 1 / sqrt(rest), is least where a child has half of the pages
    return math.ceil(8 / (1 - like) ** 2) - 1


def rest_of(paths: Column) -> Column:
    """The template of the rest of a node of few pages: what its shapes share, ``WILD`` where they differ.

    paths: array of the segments left of each shape. A level at which a shape ends differs as well.
    """
    longest = F.array_max(F.transform(paths, lambda p: F.size(p)))

    def level(i: Column) -> Column:
        alive = F.filter(paths, lambda p: F.size(p) >= i - 1)
        first = F.get(F.element_at(alive, 1), i - 1)
        return F.when(F.forall(alive, lambda p: F.get(p, i - 1).eqNullSafe(first)), first).otherwise(WILD)

    return F.when(longest > 0, F.transform(F.sequence(F.lit(1), longest), level)).otherwise(F.array().cast("array<string>"))


def shared(low: Column, high: Column) -> Column:
    """How many first segments the least and the greatest array, so all between them, have in common."""
    same = F.zip_with(low, high, lambda x, y: x.isNotNull() & y.isNotNull() & (x == y))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(low)).cast("int")


def _all(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def grow(tree: DataFrame, min_share: float = MIN_SHARE, like: float = LIKE) -> DataFrame:
    """(host, shape, n, bad, labelled) -> the same and template. ``shape``: segments joined by ``/``."""
    small = few(like)
    columns = ["host", "shape", "n", "bad", "labelled"]
    node_key = F.concat_ws("\u0001", "host", "template")
    # ``template`` is the node that a row has come to, ``left`` the segments below it
    state = materialise(tree.select(*columns, F.split("shape", "/").alias("left"), F.lit("").alias("template")).withColumn("node", node_key))
    finished: list[DataFrame] = []
    while True:
        nodes = state.groupBy("node").agg(F.sum("n").alias("nn"), F.sum("bad").alias("nbad"), F.min("left").alias("low"), F.max("left").alias("high"))
        nodes = nodes.withColumn("step", shared(F.col("low"), F.col("high")))
        # a node with one shape is at its end
        nodes = nodes.select("node", "nn", "nbad", F.slice("low", F.lit(1), F.col("step")).alias("common"), (F.col("low") == F.col("high")).alias("one"))
        moved = hot_join(state, nodes, "node")
        left = F.expr("slice(left, size(common) + 1, greatest(size(left) - size(common), 0))")
        template = F.concat_ws("/", "template", "common")
        moved = materialise(moved.select(*columns, "nn", "nbad", "one", left.alias("left"), F.when(F.size("common") == 0, F.col("template")).otherwise(template).alias("template"),
                                         "node"))
        finished.append(moved.where("one").select(*columns, "template"))
        few_pages = moved.where(~F.col("one") & (F.col("nn") <= small))
        ends = few_pages.groupBy("node").agg(rest_of(F.collect_set("left")).alias("names"))
        named = few_pages.join(ends, "node").select(*columns, F.when(F.size("left") == 0, F.col("template")).otherwise(
            F.concat_ws("/", "template", F.expr("slice(names, 1, size(left))"))).alias("template"))
        finished.append(named)
        large = moved.where(~F.col("one") & (F.col("nn") > small))
        if large.isEmpty():
            break
        own = F.coalesce(F.get("left", F.lit(0)), F.lit(END))
        after = _kind(F.get("left", F.lit(1)))
        large = large.withColumn("seg", own).withColumn("child", F.concat_ws("\u0001", "node", (F.size("left") == 0).cast("string"), own))
        counts = [F.sum(F.when(after == k, F.col("n")).otherwise(0)).alias(f"k{k}") for k in KINDS]
        child = materialise(large.groupBy("child").agg(F.first("node").alias("node"), F.min(F.size("left")).alias("low"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), *counts))
        node = child.groupBy("node").agg(F.sum("n").alias("nn"), F.sum("bad").alias("nbad"), *[F.sum(f"k{k}").alias(f"nk{k}") for k in KINDS])
        both = hot_join(child, node, "node")
        # a child is held against its siblings together
        n, rest = F.col("n"), F.nullif(F.col("nn") - F.col("n"), F.lit(0))
        apart = sum((F.abs(F.col(f"k{k}") / n - (F.col(f"nk{k}") - F.col(f"k{k}")) / rest) for k in KINDS), F.lit(0.0)) / 2
        slack = F.lit(like) + 1 / F.sqrt(n) + 1 / F.sqrt(rest)
        same_rate = F.abs(F.col("bad") / n - (F.col("nbad") - F.col("bad")) / rest) < slack
        alike, rare = F.coalesce((apart < slack) & same_rate, F.lit(False)), F.coalesce((n / F.col("nn") < min_share) & same_rate, F.lit(False))
        wild = both.select("child", ((F.col("low") > 0) & (rare | alike)).alias("wild"))
        ended = F.size("left") == 0
        named = hot_join(large, wild, "child").withColumn("template", F.when(ended, F.col("template")).otherwise(
            F.concat(F.col("template"), F.lit("/"), F.when(F.col("wild"), WILD).otherwise(F.col("seg")))))
        # paths that end at a node leave it
        finished.append(named.where(ended).select(*columns, "template"))
        if len(finished) > PARTS:
            finished = [materialise(_all(finished))]
        below = F.expr("slice(left, 2, size(left) - 1)")
        state = materialise(named.where(~ended).select(*columns, below.alias("left"), "template").withColumn("node", node_key))
    return materialise(_all(finished))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url",
               weight: float = WEIGHT, reject: float = REJECT) -> DataFrame:
    """id, host, path, rule, verdict, template, purity (the smoothed share of blocked ones among labelled pages): a row a page.

    The verdict is the longest fitting rule's, else the template's. Null urls and urls without
    ``://`` have an empty host and path and are judged like others, as one template. Repeated rows
    count as often as they stand; an empty table gives no rows; other columns are not read.
    """
    host, path = host_path(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias(id_col), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", F.array_join(shapes(F.col("path")), "/"))
    bad = F.when(F.col("_rule.verdict") == "block", 1).otherwise(0)
    tree = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.sum(bad).alias("bad"), F.count("_rule.verdict").alias("labelled"))
    grown = grow(tree)
    n, n_bad = grown.agg(F.sum("n"), F.sum("bad")).first()
    overall = (n_bad or 0) / ((n or 0) + weight)
    hosts = grown.groupBy("host").agg(((F.sum("bad") + weight * overall) / (F.sum("n") + weight)).alias("p_host"))
    templates = grown.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).join(hosts, "host")
    purity = (F.col("bad") + weight * F.col("p_host")) / (F.col("labelled") + weight)
    template_key, shape_key = F.concat_ws("\u0001", "host", "template"), F.concat_ws("\u0001", "host", "shape")
    # a host of very many shapes, and a shape of very many pages, are no single task
    judged = hot_join(grown.withColumn("_key", template_key), templates.select(template_key.alias("_key"), purity.alias("purity")), "_key")
    out = hot_join(rows.withColumn("_key", shape_key), judged.select(shape_key.alias("_key"), "template", "purity"), "_key")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return out.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
