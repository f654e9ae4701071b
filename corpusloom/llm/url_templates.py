"""URL filter by path-template trees; DataFrame functions only.

Per host the path's segments form a tree, of any depth; segments with digits become `*`. At every node the children are put in
the order of their labelled shares; neighbours in that order whose shares a two-proportion z-test doesn't tell apart are merged
into one branch, so children without labels join those of little evidence. A template's purity is that of its last node, each
node's share being smoothed towards its parent's, the host's towards that of all hosts; templates below `min_purity` are rejected.

Children enter the order as classes of equal counts, so a node with very many children has few rows there; all else are
sums by key, aggregated before the shuffle, and joins that adaptive execution can split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: (verdict, host suffix, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """A-Z lower-cased text between the first :// and /, ?, # or the end; '' without :// or for null."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; '' without :// or for null."""
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule like `net/`, its verdict) of the longest rule that fits the host or one of its parents; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, suffix, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(suffix + prefix)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The path's segments with variable ones (holding a digit, or over 40 characters) as `*`."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike("[0-9]") | (F.length(s) > 40), F.lit("*")).otherwise(s))


def judge(pages: DataFrame, url: str = "url", label: str | None = None, rules=RULES, alpha: float = 2.0, min_purity: float = 0.2, z_max: float = 1.96) -> DataFrame:
    """Add host, path, rule, template, purity and verdict.

    `label`: optional boolean column (true: wanted). Where it is null or not given, the rules' verdicts serve as labels.
    A node's purity is (wanted + alpha * m) / (labelled + alpha), where m is its parent's, and for a host the share of
    wanted ones among all labelled pages, (wanted + 1) / (labelled + 2). A merged branch is named by its place among its
    parent's, like `*0`, the least pure one first.
    Null or malformed urls have host, path and template '' and no rule; ties and repeated rows each get the same verdict;
    an empty table gives an empty result; input columns named like the added ones are replaced, others of any name pass through."""
    made = ["host", "path", "rule", "template", "purity", "verdict"]
    base = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("said", said).withColumn("segments", segments(F.col("path")))
    by_rule = F.when(F.col("said") == "allow", 1).when(F.col("said") == "block", 0)
    base = base.withColumn("good", F.coalesce(F.col("row").getField(label).cast("int"), by_rule) if label else by_rule)
    base = base.withColumn("leaf", F.array_join("segments", "/"))

    counts = [F.sum("k").alias("k"), F.sum("good").alias("good")]
    leaf = base.groupBy("host", "leaf").agg(F.count("good").alias("k"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"))
    leaf = stored(leaf.withColumn("segments", F.filter(F.split("leaf", "/"), lambda s: s != "")), "leaves")
    total = leaf.agg(*counts).first()
    everywhere = ((total["good"] or 0) + 1.0) / ((total["k"] or 0) + 2.0)

    # Nodes of the raw tree, and the branch that each is merged into.
    steps = leaf.select("host", "leaf", "k", "good", F.posexplode("segments").alias("level", "segment"), "segments")
    steps = steps.select("host", "leaf", "k", "good", "level", "segment", F.array_join(F.slice("segments", F.lit(1), F.col("level")), "/").alias("parent"))
    node = stored(steps.groupBy("host", "parent", "segment").agg(*counts), "nodes")
    share = lambda g, k: (g + 0.5) / (k + 1.0)
    alike = node.groupBy("host", "parent", "k", "good").agg(F.count("*").alias("members"))
    order = Window.partitionBy("host", "parent").orderBy(share(F.col("good"), F.col("k")), "k")
    before_k, before_good = F.lag("k").over(order), F.lag("good").over(order)
    pooled = (F.col("good") + before_good + 1.0) / (F.col("k") + before_k + 2.0)
    z = (share(F.col("good"), F.col("k")) - share(before_good, before_k)) / F.sqrt(pooled * (1 - pooled) * (1 / (F.col("k") + 1.0) + 1 / (before_k + 1.0)))
    alike = alike.withColumn("new", F.when(z >= z_max, 1).otherwise(0))
    alike = alike.withColumn("branch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = alike.groupBy("host", "parent", "branch").agg(F.sum("members").alias("size"))
    alike = alike.select("host", "parent", "k", "good", "branch").join(size, ["host", "parent", "branch"])
    named = node.join(alike, ["host", "parent", "k", "good"])
    named = named.select("host", "parent", "segment", F.when(F.col("size") > 1, F.concat(F.lit("*"), F.col("branch").cast("string"))).otherwise(F.col("segment")).alias("name"))

    # The merged tree: each leaf's names, the counts of their prefixes, and the walk down from the host.
    names = steps.select("host", "leaf", "level", "parent", "segment").join(named, ["host", "parent", "segment"])
    names = names.groupBy("host", "leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "name"))), lambda x: x["name"]).alias("names"))
    leaf = leaf.select("host", "leaf", "k", "good").join(names, ["host", "leaf"], "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    leaf = stored(leaf.withColumn("template", F.concat(F.lit("/"), F.array_join("names", "/"))), "templates")
    prefixes = F.explode(F.transform(F.sequence(F.lit(0), F.size("names")), lambda i: F.struct(i.alias("level"), F.array_join(F.slice("names", F.lit(1), i), "/").alias("prefix"))))
    tree = leaf.select("host", "template", "k", "good", prefixes.alias("p")).select("host", "template", "k", "good", "p.level", "p.prefix")
    stat = tree.groupBy("host", "level", "prefix").agg(*counts)
    walk = tree.select("host", "template", "level", "prefix").distinct().join(stat, ["host", "level", "prefix"])
    walk = walk.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("level", "k", "good"))).alias("nodes"))
    purity = F.aggregate("nodes", F.lit(everywhere), lambda m, x: (x["good"] + alpha * m) / (x["k"] + alpha))
    found = leaf.select("host", "leaf", "template").join(walk.select("host", "template", purity.alias("purity")), ["host", "template"])

    out = base.join(found.select(F.col("host").alias("h"), F.col("leaf").alias("l"), "template", "purity"), (F.col("host") == F.col("h")) & (F.col("leaf") == F.col("l")))
    verdict = F.coalesce("said", F.when(F.col("purity") < min_purity, F.lit("block")).otherwise(F.lit("allow")))
    keep = [F.col("row").getField(c).alias(c) for c in pages.columns if c not in made]
    return out.select(*keep, "host", "path", "rule", F.when(F.col("host") != "", F.col("template")).otherwise(F.lit("")).alias("template"), "purity", verdict.alias("verdict"))
