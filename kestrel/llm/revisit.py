"""WARC revisit resolution: an as-of join to the latest earlier full response.

A not-modified capture is joined, by canonical URL, to the latest full
response before it. Their validators are compared and the headers that a
304 answer may update are merged into the stored ones. Time is cut into
slots, so captures of one URL spread over (URL, slot) groups; what a slot
hands on is its last response, one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 256
# fixed values: header fields that a not-modified answer updates (RFC 9110, 15.4.5)
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def canonical_url(url):
    """Host in lower case, no scheme, default port, user part, fragment, tracking parameters or trailing slash; parameters sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "(?i)^https?://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), "^.*@", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(url.isNotNull(), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.concat_ws("&", kept))).otherwise("")))


def lowered(headers):
    """Header names in lower case, without null values; of names equal but for case the last in name order stays."""
    pairs = F.array_sort(F.filter(F.map_entries(headers), lambda e: e["value"].isNotNull()))
    keys = F.transform(pairs, lambda e: F.lower(e["key"]))
    last = F.filter(F.transform(pairs, lambda e, i: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"), i.alias("i"))),
                    lambda e: ~F.array_contains(F.slice(keys, e["i"] + 2, F.greatest(F.size(keys), F.lit(1))), e["key"]))
    return F.coalesce(F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"]))), F.create_map().cast("map<string,string>"))


def resolve(captures: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One row per revisit: record_id, url_key, target_id, outcome, headers.

    ``captures``: record_id, url, ts (long), kind (``response`` or
    ``revisit``), headers (map). Outcome: ``resolved``; ``changed`` if the
    validators disagree; ``unchecked`` if they share none; ``missing`` without an earlier response.
    Headers are the stored ones with the permitted ones of the revisit on
    top when resolved or unchecked, else the revisit's own. Earlier means a smaller ts, or the same
    ts and a smaller record_id; among equals of both any one answer is the
    same by construction of the order (kind, then headers). A null url, ts or
    record_id never matches: such responses are ignored, such revisits
    are ``missing``. Null headers are empty. Other kinds are ignored.
    """
    rows = captures.select(
        F.col("record_id").cast("long"), canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"),
        F.col("kind"), lowered(F.col("headers")).alias("headers")).where(F.col("kind").isin("response", "revisit"))
    whole = F.col("url_key").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    span = rows.where(whole).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    lo = span["lo"] or 0
    width = max(1, -(-((span["hi"] or 0) - lo + 1) // slots))
    full = F.col("kind") == "response"
    rows = rows.withColumn("slot", F.expr(f"(ts - {lo}L) div {width}L"))
    good = rows.where(whole)
    stored = F.when(full, F.struct("record_id", "headers"))
    place = F.struct(F.col("ts"), F.col("record_id"), F.expr("transform(array_sort(map_entries(headers)), e -> concat(e.key, ':', e.value))").alias("h"))
    # the last response of each slot, handed on to the next slots that have captures
    handed = good.groupBy("url_key", "slot").agg(F.max_by(F.struct("record_id", "headers"), F.when(full, place)).alias("got"), F.max(full).alias("some"))
    handed = handed.withColumn("got", F.when(F.col("some"), F.col("got")))
    over = Window.partitionBy("url_key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    handed = handed.select("url_key", "slot", F.last("got", ignorenulls=True).over(over).alias("before"))
    inside = Window.partitionBy("url_key", "slot").orderBy(
        "ts", "record_id", F.when(full, 1).otherwise(0), place["h"]).rowsBetween(Window.unboundedPreceding, -1)
    revisits = (good.withColumn("near", F.last(stored, ignorenulls=True).over(inside)).where(~full)
                .join(handed, ["url_key", "slot"]).withColumn("t", F.coalesce("near", "before")).drop("near", "before"))
    none = rows.where(~full & ~F.coalesce(whole, F.lit(False))).withColumn("t", F.lit(None).cast(revisits.schema["t"].dataType))
    both = revisits.select("record_id", "url_key", "headers", "t").unionByName(none.select("record_id", "url_key", "headers", "t"))

    def tag(h):
        return F.regexp_replace(h["etag"], "^W/", "")

    old, new = F.col("t.headers"), F.col("headers")
    tags = tag(old).isNotNull() & tag(new).isNotNull()
    dates = old["last-modified"].isNotNull() & new["last-modified"].isNotNull()
    outcome = (F.when(F.col("t").isNull(), "missing")
               .when(tags, F.when(tag(old) == tag(new), "resolved").otherwise("changed"))
               .when(dates, F.when(old["last-modified"] == new["last-modified"], "resolved").otherwise("changed"))
               .otherwise("unchecked"))
    update = F.map_filter(new, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(update, k)), update)
    return both.withColumn("outcome", outcome).select(
        "record_id", "url_key", F.col("t.record_id").alias("target_id"), "outcome",
        F.when(F.col("outcome").isin("resolved", "unchecked"), merged).otherwise(new).alias("headers"))
