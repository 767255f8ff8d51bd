"""URL filters by a sort-merge range join, in DataFrame functions only.

A rule is a host, a path and a verdict; it fits its host and all subdomains if
the url's path starts with the rule's.  Reversed host labels and path make a
canonical key, in which everything that a rule's path is a prefix of is one
interval.  A url has one point for each of its host's endings that some rule
has.  Points and interval starts are sorted together and swept: slot ``d`` of
the stack holds the last rule of nesting depth ``d`` that was met, and it is
active if its interval still covers the point.  Of the active rules the longest
wins.

Intervals of one host are nested or apart, so one slot a depth is enough, and
nothing of one host meets another's.  A host with very many urls is dealt to
several sweeps by a hash of the url, each with that host's rules; the number
follows its count of urls.

Cases: the host is what stands after the first ``://`` up to ``/``, ``?``, ``#``
or the end, A-Z lower-cased, the path what follows up to ``?``, ``#`` or the end;
both are empty for null and without ``://``; without a fitting rule the verdict
is ``default``; a rule of null host or path is left out, of rules that agree in
both ``block`` wins; rules of equal length: the longer host wins; repeated rows
are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT = "allow"
#: Points of one host ending that are swept together.
SWEEP = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sorts behind every key that starts with what stands before it.
LAST = "\U0010ffff"


def host(url: str | Column) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    return F.translate(F.regexp_extract(_after(u), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: str | Column) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(F.regexp_replace(_after(u), "^[^/?#]*", ""), "^[^?#]*", 0)


def _after(u: Column) -> Column:
    at = F.instr(F.coalesce(u, F.lit("")), "://")
    return F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))


def _labels(h: Column) -> Column:
    return F.reverse(F.split(h, "\\."))


def verdicts(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT, sweep: int = SWEEP) -> DataFrame:
    """All columns of ``pages`` in a struct ``page`` with ``host, path, rule,
    verdict`` beside it; ``rules``: host, path, verdict."""
    rules = (rules.where("host is not null and path is not null")
             .groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
             .withColumn("labels", F.size(F.split("host", "\\."))).withColumn("key", F.array_join(_labels(F.col("host")), ",")))
    # nesting depth: intervals opened and not yet closed when a rule's own opens
    ends = rules.select("*", F.explode(F.array(F.struct(F.col("path").alias("at"), F.lit(1).alias("step")), F.struct(F.concat("path", F.lit(LAST)).alias("at"), F.lit(-1).alias("step")))).alias("e"))
    opened = F.sum("e.step").over(Window.partitionBy("key").orderBy("e.at", "e.step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rules = ends.withColumn("depth", opened).where("e.step = 1").select("key", "path", "host", "verdict", "labels", "depth")
    most = rules.agg(F.max("depth").alias("depth"), F.max("labels").alias("labels")).first()
    depths, labels = most["depth"] or 0, most["labels"] or 0

    urls = pages.select(F.col(url).alias("url")).distinct().select("url", host("url").alias("host"), path("url").alias("path"))
    reversed_host = _labels(F.col("host"))
    points = urls.select("url", "path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(reversed_host), F.lit(labels)))),
                                                              lambda i: F.array_join(F.slice(reversed_host, F.lit(1), i), ","))).alias("key"))
    points = points.join(rules.select("key").distinct(), "key", "left_semi")
    hosts = points.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / sweep).cast("int").alias("sweeps"))
    point = points.join(hosts, "key").select("key", F.pmod(F.xxhash64("url"), F.col("sweeps")).cast("int").alias("salt"), "path", F.lit(1).alias("kind"), "url",
                                            F.lit(None).cast("int").alias("depth"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("verdict"))
    start = rules.join(hosts, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("sweeps") - 1)).alias("salt"), "path", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.col("depth").cast("int").alias("depth"), "host", "verdict")
    order = Window.partitionBy("key", "salt").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rule = F.struct(F.length(F.concat("host", "path")).alias("length"), F.length("host").alias("host_length"), F.concat("host", "path").alias("rule"), "verdict", F.col("path").alias("start"))
    slots = [F.last(F.when(F.col("depth") == d, rule), ignorenulls=True).over(order).alias(f"s{d}") for d in range(1, depths + 1)]
    swept = point.unionByName(start).select("kind", "url", "path", *slots).where("kind = 1")
    active = [F.when(F.startswith("path", F.col(f"s{d}.start")), F.col(f"s{d}")) for d in range(1, depths + 1)]
    if depths == 0:
        best = urls.select("url", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).where("false")
    else:
        top = F.greatest(*active) if depths > 1 else active[0]
        best = (swept.select("url", top.alias("top")).where("top is not null").groupBy("url").agg(F.max("top").alias("top"))
                .select("url", F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict")))
    page = F.struct(*[F.col(c) for c in pages.columns])
    rows = pages.select(page.alias("page"), F.col(url).alias("url")).join(best, "url", "left")
    return rows.select("page", host("url").alias("host"), path("url").alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
