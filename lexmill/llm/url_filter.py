"""URL filter by a tree of path templates per host.

Rules label the urls that they fit; the longest fitting rule decides. The other
urls are judged by their template: level by level below a host, path segments
that vary (numbers, and names of which nearly every one is new) become ``*``,
and sibling branches whose share of blocked urls does not differ significantly
from that of all their siblings are merged to ``+``. A template is rejected if
its purity, the share of blocked among labelled urls, smoothed towards the
purity of its parent, is over a limit. What lies beyond ``depth`` segments
shares its ancestor's template.

Null urls and urls without ``://`` have an empty host and path, and are allowed.
Repeated urls count as often as they occur; extra columns are not looked at.
All counts are sums per node, taken partly before they are shuffled.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.texts import stored

UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``: what stands between the first ``://`` and the next ``/ ? #``, and from there to ``?`` or ``#``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER_CASE)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def matched_rule(rules: Sequence[tuple[str, str]]) -> Column:
    """The verdict and the text of the longest rule that fits ``host`` and ``path``; a rule is (``host/path``, verdict)."""
    cases = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        cases.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*cases, F.lit(None).cast("struct<rule:string,verdict:string>"))


def template_tree(urls: DataFrame, *, depth: int = 4, distinct: int = 8, new_share: float = 0.5, z_limit: float = 2.0, weight: float = 4.0) -> DataFrame:
    """The template of each (host, path) of ``urls`` (``host, path, n, blocked, labelled``) and its smoothed purity.

    A segment varies if it has a digit, or if its siblings are at least ``distinct``
    different ones and at least ``new_share`` times as many as there are urls.
    Siblings are kept apart if their blocked share is over ``z_limit`` standard
    errors from that of all siblings. ``weight`` is the number of labelled urls
    that the parent's purity counts for.
    """
    total = urls.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("m"))
    prior = (F.col("b") + 0.5 * weight) / (F.coalesce("m", F.lit(0)) + weight)
    hosts = urls.groupBy("host").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("m")).crossJoin(F.broadcast(total.select(F.coalesce(prior, F.lit(0.5)).alias("root"))))
    hosts = hosts.select("host", ((F.col("b") + weight * F.col("root")) / (F.col("m") + weight)).alias("purity"))
    segments = F.split(F.regexp_replace("path", r"^/", ""), "/")
    nodes = urls.withColumn("segments", segments).join(hosts, "host").withColumn("template", F.lit(""))
    for level in range(depth):
        segment = F.coalesce(F.get("segments", F.lit(level)), F.lit(""))
        nodes = nodes.withColumn("segment", F.when(segment.rlike("[0-9]"), F.lit("*")).otherwise(segment))
        children = nodes.groupBy("host", "template", "segment").agg(F.sum("n").alias("n"), F.sum("blocked").alias("b"), F.sum("labelled").alias("m"))
        all_of = children.groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum("n").alias("all_n"), F.sum("b").alias("all_b"), F.sum("m").alias("all_m"))
        varies = (F.col("kinds") >= distinct) & (F.col("kinds") >= new_share * F.col("all_n"))
        rate = F.col("all_b") / F.greatest("all_m", F.lit(1))
        error = F.sqrt(rate * (1 - rate) / F.greatest("m", F.lit(1)))
        apart = (F.col("m") > 0) & (F.abs(F.col("b") / F.greatest("m", F.lit(1)) - rate) > z_limit * error)
        step = (
            F.when((F.col("segment") == "*") | (F.col("segment") == ""), F.col("segment"))
            .when(varies, F.lit("*"))
            .when(apart | (F.col("kinds") == 1), F.col("segment"))
            .otherwise(F.lit("+"))
        )
        named = children.join(all_of, ["host", "template"]).select("host", "template", "segment", step.alias("step"), "b", "m")
        totals = named.groupBy("host", "template", "step").agg(F.sum("b").alias("b"), F.sum("m").alias("m"))
        named = named.drop("b", "m").join(totals, ["host", "template", "step"])
        nodes = nodes.join(named, ["host", "template", "segment"]).withColumn(
            "purity", F.when(F.col("step") == "", F.col("purity")).otherwise((F.col("b") + weight * F.col("purity")) / (F.col("m") + weight))
        )
        nodes = nodes.withColumn("template", F.when(F.col("step") == "", F.col("template")).otherwise(F.concat("template", F.lit("/"), "step"))).drop("segment", "step", "b", "m")
        if level % 2:
            nodes = stored(nodes, "templates")
    return nodes.select("host", "path", "template", "purity")


def judge(df: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", *, limit: float = 0.5) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null if none fits), ``template``, ``purity`` and ``verdict`` (allow or block) to every row; columns of these names are replaced."""
    df = df.drop(*({"host", "path", "found", "rule", "template", "purity", "verdict"} - {url}))
    pages = with_host_and_path(df, url).withColumn("found", matched_rule(rules))
    urls = pages.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum((F.col("found.verdict") == "block").cast("long")).alias("blocked"), F.count("found.rule").alias("labelled")
    )
    templates = template_tree(urls.na.fill(0, ["blocked"]))
    known = F.col("host") != ""
    method = F.when(known & (F.col("purity") > limit), F.lit("block")).otherwise(F.lit("allow"))
    return pages.join(templates, ["host", "path"]).select(
        *df.columns, "host", "path", F.col("found.rule").alias("rule"), "template", "purity", F.coalesce("found.verdict", method).alias("verdict")
    )
