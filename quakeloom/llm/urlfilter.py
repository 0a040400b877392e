"""URL filters by a path-template tree.

The pages of a host span a tree of path segments. Below each node, what all paths share is skipped in one step; of the segments where they
part, rare ones of many kinds become a wildcard; children whose label rates do not differ statistically are merged into one branch; each
leaf is a template. A template is rejected if the smoothed share of bad labels among its pages is high: labels are
few, so the share is drawn to the host's and the corpus's own. A page gets the verdict of the template it falls in.

Explicit rules (host suffix and path prefix) come first; the longest that fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rules of the contract: (verdict, host and path prefix). Fixed values.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: A segment is rare if it has up to this share of its node's pages; rare ones vary if there is more than so many different ones for a page.
RARE, VARIES = 0.02, 0.2
#: z of two rates that differ; labels' worth of the prior; share of bad from which on a template is rejected.
Z, PRIOR, REJECT = 2.0, 8.0, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: up to ``/ ? #`` with A-Z lower-cased, and from there up to ``? #``; both empty without it."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits; null for none. A rule fits its host and all below it."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def templates(pages: DataFrame) -> DataFrame:
    """``host, segs, template, known, bad`` of every distinct path from ``host, path, bad`` (bad: 1, 0 or null).

    A template has ``*`` for a varying segment, ``~`` for merged children and the segment after ``=`` for others, so that no url can name
    a mark. Only distinct
    paths and counts are shuffled. Rounds go on until no path does, one for each place where paths of a node part.
    """
    level = pages.groupBy("host", _segments(F.col("path")).alias("segs")).agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("known"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    level = materialize(level.select("host", "segs", F.lit("").alias("node"), F.lit(0).alias("at"), "n", "known", "bad"), "paths")
    done, counts = None, ("n", "known", "bad")
    while True:
        rest = F.slice("segs", F.col("at") + 1, F.array_size("segs"))
        ends = level.groupBy("host", "node").agg(F.min(rest).alias("low"), F.max(rest).alias("high"))  # what these two share, all do
        differ = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), False)
        shared = F.when(differ == 0, F.array_size("low")).otherwise((differ - 1).cast("int"))
        steps = ends.select(F.col("host").alias("h"), F.col("node").alias("nd"), shared.alias("c"), F.slice("low", F.lit(1), shared).alias("common"))
        level = level.join(steps, (F.col("host") == F.col("h")) & (F.col("node") == F.col("nd")))
        longer = F.when(F.col("c") == 0, F.col("node")).otherwise(F.concat("node", F.lit("/="), F.array_join("common", "/=")))
        at = F.col("at") + F.col("c")
        level = materialize(level.select("host", "segs", longer.alias("node"), at.alias("at"), *counts, F.get("segs", at).alias("seg")), "nodes")
        out = level.where("seg is null").select("host", "segs", F.col("node").alias("template"), "known", "bad")
        done = out if done is None else done.union(out)
        level = level.where("seg is not null")
        if level.isEmpty():
            return done
        child = level.groupBy("host", "node", "seg").agg(*[F.sum(c).alias(c) for c in counts])
        whole = child.groupBy("host", "node").agg(*[F.sum(c).alias(f"all_{c}") for c in counts])
        both = child.join(whole, ["host", "node"]).withColumn("rare", F.col("n") <= F.greatest(F.lit(1.0), RARE * F.col("all_n")))
        odd = both.where("rare").groupBy("host", "node").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("rows"))
        both = both.join(odd, ["host", "node"], "left")
        varies = F.coalesce(F.col("rare") & (F.col("kinds") > F.greatest(F.lit(1.0), VARIES * F.col("rows"))), F.lit(False))
        # Siblings whose rate does not differ from that of the rest are one branch.
        rest_known, rest_bad = F.col("all_known") - F.col("known"), F.col("all_bad") - F.col("bad")
        pooled = (F.col("all_bad") + 1) / (F.col("all_known") + 2)
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest("known", F.lit(1)) + 1 / F.greatest(rest_known, F.lit(1))))
        z = (F.col("bad") / F.greatest("known", F.lit(1)) - rest_bad / F.greatest(rest_known, F.lit(1))) / error
        differs = (F.col("known") > 0) & (rest_known > 0) & (F.abs(z) > Z)
        branch = F.when(varies, F.lit("*")).when(differs, F.concat(F.lit("="), "seg")).otherwise(F.lit("~"))
        step = both.select(F.col("host").alias("h"), F.col("node").alias("nd"), F.col("seg").alias("sg"), branch.alias("branch"))
        down = level.join(step, (F.col("host") == F.col("h")) & (F.col("node") == F.col("nd")) & (F.col("seg") == F.col("sg")))
        level = materialize(down.select("host", "segs", F.concat("node", F.lit("/"), "branch").alias("node"), (F.col("at") + 1).alias("at"), *counts), "paths")


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, bad_share`` for every row of ``pages``.

    ``labels``: (page_id, bad), bad 1 or 0; its null rows are left out, of repeated ids one bad counts. A null or
    malformed url has an empty host and path. The smoothed share alone decides, also for a template without labels. Hot hosts are combined
    map-side: only counts of distinct paths meet.
    """
    host, path = host_and_path(F.col(url_col))
    own = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    known = labels.where("page_id is not null and bad is not null").groupBy(F.col("page_id").alias("p")).agg(F.max("bad").cast("long").alias("bad"))
    own = materialize(own.join(known, own.page_id == known.p, "left").drop("p"), "pages")
    shapes = materialize(templates(own), "templates")
    by = shapes.groupBy("host", "template").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    hosts = by.groupBy(F.col("host").alias("h")).agg(F.sum("known").alias("host_known"), F.sum("bad").alias("host_bad"))
    total = by.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("known"), F.lit(0)) + 4)).alias("rate"))  # one row
    smooth = by.join(hosts, by.host == hosts.h).crossJoin(F.broadcast(total))
    prior = (F.col("host_bad") + PRIOR * F.col("rate")) / (F.col("host_known") + PRIOR)
    share = (F.col("bad") + PRIOR * prior) / (F.col("known") + PRIOR)
    judged = smooth.select(F.col("host").alias("jh"), F.col("template").alias("jt"), share.alias("bad_share"))
    by_shape = shapes.join(judged, (shapes.host == judged.jh) & (shapes.template == judged.jt)).select(F.col("host").alias("sh"), F.col("segs").alias("ss"), "template", "bad_share")
    rows = own.withColumn("segs", _segments(F.col("path"))).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.join(by_shape, (rows.host == by_shape.sh) & (rows.segs == by_shape.ss), "left")
    method = F.when(F.col("bad_share") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(F.col("page_id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", method).alias("verdict"), F.regexp_replace("template", "/=", "/").alias("template"), "bad_share")
