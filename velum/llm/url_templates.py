"""URL filter by a tree of path templates per host.

Segments that are numbers, codes or dates are typed by their form. Level by level, a node
with many children that seldom repeat gets a wildcard in their place, and labelled children
whose labels are alike within the width of a bin on the arcsine scale, where shares have
about the same error, merge into one branch. The leaves are templates; one is rejected when
its purity, the smoothed share of bad pages, is half or more.

Each node is smoothed towards its parent: its labelled pages count, and ``SMOOTHING`` more
with the share of the node above. So the labels of a host reach its branches without labels,
and those of a branch the templates below it. The share of a host itself is that of its bad
pages among all of its pages, smoothed by the mean of that over all hosts, in which a host
with a great many pages counts once.

A path is followed for ``DEPTH`` segments and beyond that for as long as a branch holds both
good and bad pages: what is folded has labels of one kind, or none.

Pages are summed by host and typed path first, so a host with a third of all pages enters
the tree with the number of its typed paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.llm.shared import Scratch, col

DEPTH = 8
MANY_CHILDREN = 16
PAGES_PER_CHILD = 4
BIN = 0.35
SMOOTHING = 4.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end; ASCII
    capitals in lower case. Empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def typed_segments(path: Column) -> Column:
    """Segments of a path with variable forms replaced."""

    def typed(s: Column) -> Column:
        form = F.regexp_replace(s, r"^\d{4}-\d{1,2}(-\d{1,2})?(?=$|\.)", "{date}")
        form = F.regexp_replace(form, r"^\d+(?=$|\.)", "{num}")
        code = r"^(?=.*\d)[0-9a-fA-F]{8,}(-[0-9a-fA-F]{4,})*(?=$|\.)"
        return F.regexp_replace(form, code, "{code}")

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), typed)


def _share(part: Column, whole: Column) -> Column:
    """A share on the arcsine scale, in bins; 0 of 0 is a bin of its own."""
    scaled = F.floor(F.asin(F.sqrt(part / whole)) / BIN)
    return F.when(whole > 0, scaled).otherwise(-1)


def path_templates(paths: DataFrame, scratch: Scratch) -> DataFrame:
    """``paths`` (``host, typed, n, bad, good``) with ``template`` and ``purity``."""
    hosts = paths.groupBy("host").agg(F.sum("n").alias("all"), F.sum("bad").alias("bad"))
    prior = hosts.agg(F.coalesce(F.avg(F.col("bad") / F.col("all")), F.lit(0.0))).first()[0]
    start = (F.col("bad") + SMOOTHING * prior) / (F.col("all") + SMOOTHING)
    tree = paths.join(hosts.select("host", start.alias("purity")), "host").withColumns(
        {"template": F.lit(""), "open": F.lit(True)}
    )
    tree = scratch.keep(tree, "level0")
    level = 0
    while True:
        going = F.col("open") & (F.size("typed") > level)
        if tree.filter(going).isEmpty():
            return tree
        here = tree.withColumn("child", F.when(going, F.get("typed", F.lit(level))))
        wide = (
            here.filter("child IS NOT NULL")
            .groupBy("host", "template", "child")
            .agg(F.sum("n").alias("n"))
            .groupBy("host", "template")
            .agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
            .filter((F.col("kinds") >= MANY_CHILDREN) & (F.col("n") < PAGES_PER_CHILD * F.col("kinds")))
            .select("host", "template", F.lit(True).alias("wide"))
        )
        here = here.join(wide, ["host", "template"], "left").withColumn(
            "child", F.when(F.col("wide") & F.col("child").isNotNull(), "{any}").otherwise(F.col("child"))
        )
        here = scratch.keep(here.drop("wide"), f"children{level}")
        known = F.col("bad") + F.col("good")
        branches = (
            here.filter("child IS NOT NULL")
            .groupBy("host", "template", "child")
            .agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")])
            .withColumns({"seen": _share(known, F.col("n")), "kind": _share(F.col("bad"), known)})
        )
        alike = (
            branches.filter(known > 0)
            .groupBy("host", "template", "seen", "kind")
            .agg(F.count("*").alias("merged"), F.min("child").alias("least"))
            .filter("merged > 1")
        )
        named = branches.join(alike, ["host", "template", "seen", "kind"], "left").select(
            "host", "template", "child", "bad", "good",
            F.coalesce(F.concat(F.lit("{like "), "least", F.lit("}")), "child").alias("branch"),
        )
        labels = named.groupBy("host", "template", "branch").agg(
            F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good")
        )
        named = named.drop("bad", "good").join(labels, ["host", "template", "branch"])
        level += 1
        purity = (F.col("all_bad") + SMOOTHING * F.col("purity")) / (
            F.col("all_bad") + F.col("all_good") + SMOOTHING
        )
        mixed = (F.col("all_bad") > 0) & (F.col("all_good") > 0)
        opened = mixed if level >= DEPTH else F.lit(True)
        folded = F.when(~opened & (F.size("typed") > level), "/{deep}").otherwise("")
        step = F.concat(F.lit("/"), "branch", folded)
        moves = F.col("branch").isNotNull()
        tree = here.join(named, ["host", "template", "child"], "left").select(
            "host", "typed", "n", "bad", "good",
            F.when(moves, purity).otherwise(F.col("purity")).alias("purity"),
            F.concat("template", F.coalesce(step, F.lit(""))).alias("template"),
            F.coalesce(moves & opened, F.lit(False)).alias("open"),
        )
        tree = scratch.keep(tree, f"level{level}")
        scratch.drop(f"level{level - 1}", f"children{level - 1}")


def filter_urls(
    pages: DataFrame, rules: tuple[Rule, ...], url: str = "url", page_id: str = "page_id"
) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity``, one row per row of ``pages``.

    ``rule`` is the longest rule that fits, whose verdict holds and whose pages are the
    labels of the tree; ``purity`` is the smoothed share of bad pages of the template, and
    ``verdict`` follows from it where no rule fits.
    Null urls, and urls without ``://``, have an empty host and path."""
    scratch = Scratch(pages.sparkSession)
    rows = pages.select(
        col(page_id).alias("page_id"), host_of(col(url)).alias("host"), path_of(col(url)).alias("path")
    )
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": ruled, "typed": typed_segments(F.col("path"))})
    bad, good = (F.coalesce(F.col("ruled") == v, F.lit(False)).cast("long") for v in ("block", "allow"))
    paths = rows.groupBy("host", "typed").agg(
        F.count("*").alias("n"), F.sum(bad).alias("bad"), F.sum(good).alias("good")
    )
    paths = scratch.keep(paths, "paths")
    known = path_templates(paths, scratch).select("host", "typed", "template", "purity")
    learned = F.when(F.col("purity") >= 0.5, "block").otherwise("allow")
    return rows.join(known, ["host", "typed"]).select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", learned).alias("verdict"),
        "template", "purity",
    )
