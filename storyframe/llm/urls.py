"""URL filters: host and path rules, and a path-template tree for what no rule decides.

The tree has a branch per host, and one of all hosts together (the pool).  Going down one path segment at a time, a
segment becomes a wildcard when it looks variable (its digits, or a long token of hex digits).  Labelled siblings whose
share of blocked pages can't be told from their parent's are merged; where a parent has too many children, unlabelled ones
are merged too, but never with labelled ones: how many children were crawled changes no verdict.  Below a depth only
branches are followed whose labels differ: where all labels agree, or none are, deeper templates couldn't differ.

The labels are the pages that a rule decides.  A template's purity is the share of blocked among them, shrunk towards the
pool's purity of the same path, in which every site has one opinion.  So what was learned on other sites decides where a
host has no labels of its own; one site alone rejects nothing elsewhere.  Templates of high purity are blocked.
All steps work on counts of distinct (host, path shape), never on the pages of a host together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# (verdict, rule): host, then path.  The rules of the task.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
POOL = "/"  # the host of all hosts' tree: no host holds a slash
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def ruled(rules, what) -> Column:
    """``what`` of the longest rule that fits (host, path), or null."""
    out = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, rest = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + rest)
        out = F.when(fits, F.lit(what(verdict, rule))).otherwise(out)
    return out


def shape(path: Column) -> Column:
    """Segments of a path, variable ones generalised."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike("^[0-9a-fA-F-]{16,}$"), F.lit("*")).otherwise(F.regexp_replace(s, "[0-9]+", "*")))


def templates(counts: DataFrame, depth: int = 4, fanout: int = 64, z: float = 2.0) -> DataFrame:
    """(host, parts, n, blocked, labelled, template, above) of (host, parts, n, blocked, labelled).

    above: the templates on the way to it, from the root.  ``*#`` are merged labelled segments, ``*?`` merged unlabelled
    ones beside labelled ones, ``**`` all that lies below ``depth`` segments where labels don't differ (none of them can
    occur in a path's shape).
    """
    now = counts.withColumn("template", F.lit("")).withColumn("above", F.array().cast("array<string>")).withColumn("open", F.lit(True))
    k = 0
    while True:
        now = now.withColumn("part", F.when(F.col("open"), F.get("parts", F.lit(k))))
        if k >= depth:  # the deeper way is only for branches whose labels differ
            mixed = now.where("part is not null").groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
            mixed = mixed.select("host", "template", ((F.col("b") > 0) & (F.col("b") < F.col("l"))).alias("mixed"))
            now = now.join(mixed, ["host", "template"], "left").withColumn("ends", F.col("part").isNotNull() & ~F.col("mixed"))
            now = now.withColumn("above", F.when(F.col("ends"), F.array_append("above", F.col("template"))).otherwise(F.col("above")))
            now = now.withColumn("template", F.when(F.col("ends"), F.concat("template", F.lit("/**"))).otherwise(F.col("template")))
            now = written(now.withColumn("part", F.when(F.col("mixed"), F.col("part"))).drop("mixed", "ends"), "level")
            if not now.where("part is not null").head(1):
                return now.drop("part", "open")
        child = now.where("part is not null").groupBy("host", "template", "part").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
        parent = child.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("b").alias("all_b"), F.sum("l").alias("all_l"))
        share = F.try_divide("all_b", "all_l")
        far = F.abs(F.col("b") - F.col("l") * share) / F.sqrt(F.col("l") * share * (1 - share) + 1)
        alike = (F.col("children") > 1) & (F.col("l") > 0) & (far < z)
        many = (F.col("children") > fanout) & (F.col("l") == 0)
        name = F.when(alike, "*#").when(many & (F.col("all_l") > 0), "*?").when(many, "*").otherwise(F.col("part"))
        step = child.join(parent, ["host", "template"]).select("host", "template", "part", F.concat("template", F.lit("/"), name).alias("deeper"))
        now = now.join(step, ["host", "template", "part"], "left").withColumn("open", F.col("deeper").isNotNull())
        now = now.withColumn("above", F.when(F.col("open"), F.array_append("above", F.col("template"))).otherwise(F.col("above")))
        now = now.withColumn("template", F.coalesce("deeper", "template")).drop("deeper", "part")
        now = written(now, "level")  # each level is read several times: without a cut the plan would grow as a power of the depth
        k += 1


def site_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def purities(tree: DataFrame, smoothing: float) -> DataFrame:
    """(host, parts, template, purity) of the trees; the pool's host is POOL.

    In the pool a site's pages are one opinion: the blocked share of those that rules decide.  A pool template's purity is
    the mean of its sites' opinions, shrunk towards one half; without any, it is that of the next template above that has
    some (the root has none: labels of one branch say nothing about another).  A host's template is shrunk towards the
    pool's purity of the same path, as if that were ``smoothing`` more labelled pages.
    """
    pool, own = tree.where(F.col("host") == POOL), tree.where(F.col("host") != POOL)
    nodes = F.filter(F.array_append("above", F.col("template")), lambda t: t != "")
    path = pool.select("parts", nodes.alias("nodes"))
    site = own.groupBy(site_of(F.col("host")).alias("site"), "parts").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).where("l > 0")
    opinion = site.join(path, "parts").select("site", "b", "l", F.explode("nodes").alias("node")).groupBy("node", "site").agg((F.sum("b") / F.sum("l")).alias("share"))
    opinion = written(opinion.groupBy("node").agg(((F.sum("share") + smoothing * 0.5) / (F.count("*") + smoothing)).alias("p")), "opinions")
    known = path.select("parts", F.posexplode("nodes").alias("at", "node")).join(opinion, "node").groupBy("parts").agg(F.max_by("p", "at").alias("prior"))
    score = own.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    prior = F.coalesce("prior", F.lit(0.5))
    own = own.join(score, ["host", "template"]).join(known, "parts", "left")
    return own.select("host", "parts", "template", ((F.col("b") + smoothing * prior) / (F.col("l") + smoothing)).alias("purity"))


def judge(pages: DataFrame, rules=RULES, depth: int = 4, fanout: int = 64, smoothing: float = 1.0, purity: float = 0.8) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity): one row per page.

    A null url, or one without ``://``, has an empty host and path and meets no rule.  Repeated rows are judged alike,
    and their labels count each; equal purities get equal verdicts; very long urls are read whole; an empty table gives
    no rows; other columns are ignored.  ``depth``: segments that templates always spell, and more where labels differ.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    base = base.withColumn("rule", ruled(rules, lambda _, r: r)).withColumn("ruled", ruled(rules, lambda v, _: v)).withColumn("parts", shape(F.col("path")))
    counts = written(base.groupBy("host", "parts").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("blocked"), F.count("ruled").alias("labelled")), "shapes")
    pool = counts.groupBy(F.lit(POOL).alias("host"), "parts").agg(*[F.sum(c).alias(c) for c in ("n", "blocked", "labelled")])
    tree = templates(counts.unionByName(pool), depth, fanout)
    found = written(purities(tree, smoothing), "templates").withColumnsRenamed({"host": "h", "parts": "p"})
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= purity, F.lit("block")).otherwise(F.lit("allow")))
    return base.join(found, (F.col("host") == F.col("h")) & (F.col("parts") == F.col("p")), "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
