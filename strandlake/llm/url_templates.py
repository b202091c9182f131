"""URL filters: a tree of path templates for each host, built from counts, with smoothed labelled purity.

Paths are counted by host and segments; a segment that holds a digit is a wildcard at once, so a path table is far
smaller than the pages. Then, from the top of each host's tree down to its last segments, the branches below a node are
compared: a branch whose labelled purity does not differ from that of all its siblings together by more than `z` standard
errors is merged into the wildcard, one that differs is kept however rare it is. What is left are
templates such as `/en/*`. A template's purity is its share of good labelled pages, smoothed towards its host's, which
is smoothed towards the share of all; a page is blocked where it is under `least`.

Everything is DataFrame expressions. Each level is an aggregation by (host, template so far, segment), then one by
(host, template so far), joined: no node, however large, has to be in one task.

Defined results: a url that is null or has no `://` has host and path "" and falls under the template of host ""; tied
and repeated rows, and null ids, are judged like any other; a star in a url is written `\\*` in a template, so it isn't a
wildcard; a url of any length is read whole, and a path has as many levels as segments; further columns, of any name,
aren't read; an empty table gives an empty result; without labels, nothing is blocked but by rule.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labels_of, stored, table

#: (rule, verdict) of the query.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
END, ANY = "", "*"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; "" if there is none."""
    rest = F.get(F.split(url, "://", 2), F.lit(1))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.get(F.split(url, "://", 2), F.lit(1))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule of a short list whose host is the url's or a parent of it and whose path begins the url's."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        domain, slash, tail = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + tail)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def parsed(pages: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """page_id, host, path, rule, ruled (the rule's verdict or null), and key: the path with its digits generalised."""
    out = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = reduce(lambda a, x: F.when(F.col("rule") == x[0], x[1]).otherwise(a), rules, F.lit(None).cast("string"))
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    key = F.array_join(F.transform(segments, lambda x: F.when(x.rlike("[0-9]"), F.lit(ANY)).otherwise(F.replace(x, F.lit(ANY), F.lit("\\" + ANY)))), "/")
    return out.withColumns({"ruled": ruled, "key": key})


def grow_tree(paths: DataFrame, z: float = 1.96) -> DataFrame:
    """paths (host, key, n, labelled, good) with template. Levels go on until no node that could have branches is left."""
    counts, active, done = ("n", "labelled", "good"), paths.withColumn("template", F.lit("")), []
    size = F.when(F.col("key") == "", 0).otherwise(F.size(F.split("key", "/")))
    for level in count():
        nodes = active.groupBy("host", "template").agg(F.count("*").alias("keys"), *[F.sum(c).alias(f"all_{c}") for c in counts])
        # Where labels are all alike, or there is one key, no branch below can differ: all that is left are wildcards.
        mixed = (F.col("keys") > 1) & (F.col("all_good") > 0) & (F.col("all_good") < F.col("all_labelled"))
        nodes = nodes.select("host", "template", mixed.alias("mixed"), *[f"all_{c}" for c in counts])
        active = stored(active.join(nodes, ["host", "template"]), f"url-level{level}")
        tail = F.repeat(F.lit("/" + ANY), F.greatest(size - level, F.lit(0)))
        done.append(active.where("NOT mixed").select(*paths.columns, F.concat("template", tail).alias("template")))
        active = active.where("mixed").drop("mixed")
        if active.isEmpty():
            return reduce(DataFrame.unionByName, done)
        segment = F.when(F.col("key") == "", END).otherwise(F.coalesce(F.get(F.split("key", "/"), F.lit(level)), F.lit(END)))
        active = active.withColumn("segment", segment)
        every = [f"all_{c}" for c in counts]
        both = active.groupBy("host", "template", "segment", *every).agg(*[F.sum(c).alias(c) for c in counts])
        others, pooled = F.col("all_labelled") - F.col("labelled"), (F.col("all_good") + 1) / (F.col("all_labelled") + 2)
        gap = F.try_divide(F.col("good"), F.col("labelled")) - F.try_divide(F.col("all_good") - F.col("good"), others)
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), F.col("labelled")) + F.try_divide(F.lit(1), others)))
        differs = F.coalesce(F.abs(gap) > z * error, F.lit(False))
        branch = F.when(F.col("segment") == END, END).when(~differs, ANY).otherwise(F.col("segment"))
        names = both.select("host", "template", "segment", branch.alias("branch"))
        active = stored(active.drop(*every).join(names, ["host", "template", "segment"]), f"url-branches{level}")
        done.append(active.where(F.col("branch") == END).select(*paths.columns, "template"))
        active = active.where(F.col("branch") != END).select(*paths.columns, F.concat("template", F.lit("/"), "branch").alias("template"))


def purity(tree: DataFrame, strength: float = 10.0) -> DataFrame:
    """One row for each host and template: purity, smoothed towards the host's and the share of all."""
    total = tree.agg(F.sum("good"), F.sum("labelled")).first()
    share = ((total[0] or 0) + 1) / ((total[1] or 0) + 1)
    hosts = tree.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("labelled").alias("host_labelled"))
    hosts = hosts.select("host", ((F.col("host_good") + strength * share) / (F.col("host_labelled") + strength)).alias("host_purity"))
    out = tree.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "good")]).join(hosts, "host")
    return out.select("host", "template", ((F.col("good") + strength * F.col("host_purity")) / (F.col("labelled") + strength)).alias("purity"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, least: float = 0.5, **options) -> DataFrame:
    """pages (page_id, url) with host, path, rule, template, purity and verdict. labels: page_id, good (0 or 1)."""
    rows = parsed(pages, rules)
    labels = labels.where("page_id IS NOT NULL AND good IS NOT NULL").groupBy("page_id").agg(F.min("good").alias("good"))
    counted = rows.join(labels, "page_id", "left")
    paths = counted.groupBy("host", "key").agg(F.count("*").alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    tree = stored(grow_tree(stored(paths, "url-paths"), **options), "url-tree")
    found = tree.select("host", "key", "template").join(purity(tree), ["host", "template"])
    out = rows.join(stored(found, "url-purity"), ["host", "key"])
    own = F.when(F.col("purity") < least, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", "purity")


def labels_by_url(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, good: a page is labelled as the document is whose id is the number in its path's last segment."""
    number = F.regexp_extract(path_of(F.col("url")), r"([0-9]{1,18})[^/0-9]*/?$", 1).try_cast("long")
    quality, toxic = labels_of(labels, "quality").withColumnRenamed("label", "quality"), labels_of(labels, "toxic").withColumnRenamed("label", "toxic")
    known = quality.join(toxic, "doc_id", "full")
    good = (F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return pages.select("page_id", number.alias("doc_id")).where("doc_id IS NOT NULL").join(known, "doc_id").select("page_id", good.cast("int").alias("good"))


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, labels_by_url(pages, table(spark, sf_dir, "labels")))


QUERIES = {"op2_url_templates": op2_url_templates}
