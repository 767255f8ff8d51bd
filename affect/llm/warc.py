"""WARC not-modified revisits: an as-of join by canonical url.

Every revisit record is resolved to the latest earlier full response (type
``response``, status 200) of its canonical url.  Its validators are checked
against that response's (entity tag by strong comparison; without tags the date
of the last change), and if they agree, the response's headers are taken with
those that a 304 answer may change put in.

One window does the join.  A url with very many records would be one sorted
group, so time is cut into blocks; the last response of every block, aggregated
first, is carried to the url's next blocks, and the window runs by url and
block.

Cases: statuses are ``resolved``, ``validator_mismatch``, ``no_validator`` (there
is an earlier response, but no validator that both have) and
``no_earlier_response``; only ``resolved`` has headers; records of the same time
are not earlier; of several responses of the latest time the greatest record id
is taken; revisits without a url or time have no earlier response; responses
without them serve none; null headers are none, of header names that differ in
case only or repeat in a record the last value counts; repeated records are
resolved each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The header fields that a 304 answer may change (RFC 9110, 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
#: Records of a block of time, on average.
BLOCK = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(url: str | Column) -> Column:
    """Without scheme, fragment, ``utm_`` parameters and a closing slash of the path; host in small letters."""
    u = F.col(url) if isinstance(url, str) else url
    bare = F.regexp_replace(F.regexp_replace(u, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    name = F.regexp_extract(bare, "^[^/?]*", 0)
    rest = F.regexp_replace(F.substring(bare, F.length(name) + 1, F.length(bare)), "([?&])utm_[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&&+", "&"), "[?]&", "?"), "[?&]$", "")
    return F.concat(F.translate(name, UPPER, LOWER), F.regexp_replace(F.regexp_replace(rest, "/[?]", "?"), "/$", ""))


def _headers(c: Column) -> Column:
    """Names in small letters, the last of equal names, in order of names."""
    small = F.transform(F.coalesce(c, F.array().cast("array<struct<name: string, value: string>>")),
                        lambda h, i: F.struct(F.lower(h["name"]).alias("name"), i.alias("i"), h["value"].alias("value")))
    last = F.filter(small, lambda h: ~F.exists(small, lambda g: (g["name"] == h["name"]) & (g["i"] > h["i"])))
    return F.sort_array(F.transform(last, lambda h: F.struct(h["name"].alias("name"), h["value"].alias("value"))))


def value_of(headers: Column, name: str) -> Column:
    return F.get(F.filter(headers, lambda h: h["name"] == name), F.lit(0))["value"]


def resolve_revisits(records: DataFrame, block: int = BLOCK) -> DataFrame:
    """``records``: record_id, url, type, status, ts, headers (array of name and
    value), digest.  Returns for every revisit: record_id, url (canonical),
    ts, response_id, status, digest and headers, as if it had been a full response."""
    ids = records.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    blocks = max(1, -(-ids["n"] // block))
    lo, hi = (int(ids["lo"]), int(ids["hi"])) if ids["lo"] is not None else (0, 0)
    width = max(1, -(-(hi - lo + 1) // blocks))
    rows = records.select("record_id", canonical("url").alias("key"), "ts", "type", F.col("status").alias("code"), _headers(F.col("headers")).alias("headers"), "digest")
    rows = rows.withColumn("block", F.floor((F.col("ts") - lo) / width).cast("bigint"))
    full = F.struct("ts", "record_id", "headers", "digest")
    known = F.col("key").isNotNull() & F.col("ts").isNotNull()
    responses = rows.where(known & (F.col("type") == "response") & (F.col("code") == 200)).select("key", "block", "ts", full.alias("response"))
    revisits = rows.where(F.col("type") == "revisit")
    # each block of a url that has revisits starts with the last response of the url's blocks before
    of_block = responses.groupBy("key", "block").agg(F.max_by("response", F.struct("response.ts", "response.record_id")).alias("last"))
    wanted = revisits.where(known).select("key", "block").distinct().withColumn("last", F.lit(None).cast(of_block.schema["last"].dataType)).withColumn("wants", F.lit(1))
    steps = of_block.withColumn("wants", F.lit(0)).unionByName(wanted)
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("key").orderBy("block").rangeBetween(Window.unboundedPreceding, -1))
    carried = steps.withColumn("response", before).where("wants = 1 and response is not null").select("key", "block", F.lit(lo).cast("bigint").alias("ts"), "response")
    event = carried.withColumn("kind", F.lit(0)).unionByName(responses.withColumn("kind", F.lit(2))).select("key", "block", "ts", "kind", "response", F.lit(None).cast(f"struct<{_fields(rows)}>").alias("revisit"))
    asked = revisits.select("key", "block", "ts", F.lit(1).alias("kind"), F.lit(None).cast(responses.schema["response"].dataType).alias("response"),
                            F.struct("record_id", "headers").alias("revisit"))
    # carried responses first, then by time: a revisit stands before the responses of its own time
    order = Window.partitionBy("key", "block").orderBy(F.when(F.col("kind") == 0, 0).otherwise(1), "ts", "kind", "response.record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = event.unionByName(asked).select("key", "ts", "kind", "revisit", F.last("response", ignorenulls=True).over(order).alias("response")).where("kind = 1")
    joined = joined.withColumn("response", F.when(F.col("key").isNotNull() & F.col("ts").isNotNull(), F.col("response")))
    mine, its = F.col("revisit.headers"), F.col("response.headers")
    tag, its_tag = value_of(mine, "etag"), value_of(its, "etag")
    changed, its_changed = value_of(mine, "last-modified"), value_of(its, "last-modified")
    strong = ~F.startswith(tag, F.lit("W/")) & (tag == its_tag)
    agrees = F.when(tag.isNotNull() & its_tag.isNotNull(), strong).when(changed.isNotNull() & its_changed.isNotNull(), changed == its_changed)
    status = (F.when(F.col("response").isNull(), "no_earlier_response").when(agrees.isNull(), "no_validator").when(agrees, "resolved").otherwise("validator_mismatch"))
    new = F.filter(mine, lambda h: h["name"].isin(PERMITTED))
    kept = F.filter(its, lambda h: ~F.exists(new, lambda n: n["name"] == h["name"]))
    out = joined.select(F.col("revisit.record_id").alias("record_id"), F.col("key").alias("url"), "ts", F.col("response.record_id").alias("response_id"),
                        status.alias("status"), F.col("response.digest").alias("digest"), F.sort_array(F.concat(kept, new)).alias("headers"))
    resolved = F.col("status") == "resolved"
    return out.select("record_id", "url", "ts", "response_id", "status", F.when(resolved, F.col("digest")).alias("digest"), F.when(resolved, F.col("headers")).alias("headers"))


def _fields(rows: DataFrame) -> str:
    return ", ".join(f"{c}: {t}" for c, t in rows.select("record_id", "headers").dtypes)


def captures(pages: DataFrame) -> DataFrame:
    """Records of a crawl derived from ``pages`` (page_id, url, html), four for
    each page: a revisit before anything else, the page itself, a revisit that
    a fifth of the pages answer with other validators, and one that names the
    url differently and has only the date of the last change."""
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    page = F.coalesce(F.col("page_id"), F.lit(0))

    def header(name: str, value: Column):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    def record(n: int, url: Column, kind: str, status: int, step: int, headers: list):
        return F.struct((page * 4 + n).alias("record_id"), url.alias("url"), F.lit(kind).alias("type"), F.lit(status).alias("status"),
                        (page * 1000 + step).alias("ts"), F.array(*headers).alias("headers"), (F.md5(F.coalesce("html", F.lit(""))) if kind == "response" else F.lit(None).cast("string")).alias("digest"))

    url = F.col("url")
    day = F.concat(F.lit("day "), (page % 7).cast("string"))
    four = F.array(
        record(0, url, "revisit", 304, 0, [header("ETag", tag), header("Date", F.lit("first"))]),
        record(1, url, "response", 200, 10, [header("Content-Type", F.lit("text/html")), header("ETag", tag), header("Last-Modified", day), header("Date", F.lit("second"))]),
        record(2, F.concat(url, F.lit("#again")), "revisit", 304, 20,
               [header("etag", F.when(page % 5 == 0, F.lit('"other"')).otherwise(tag)), header("Date", F.lit("third")), header("Content-Type", F.lit("text/plain")), header("Vary", F.lit("accept"))]),
        record(3, F.concat(F.regexp_replace(url, "^http:", "https:"), F.when(F.instr(url, "#") > 0, F.lit("")).when(F.instr(url, "?") > 0, F.lit("&utm_id=1")).otherwise(F.lit("?utm_id=1"))), "revisit", 304, 30,
               [header("Last-Modified", day), header("Expires", F.lit("never")), header("Content-Length", F.lit("0"))]))
    return pages.select(F.inline(four))
