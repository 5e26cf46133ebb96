"""Resolving not-modified revisits of a web archive.

A revisit record has no payload: it says that the page was as before. It is joined as of its time to the latest strictly
earlier full response of its canonical URL; where both carry a validator (etag, else payload digest) these must agree.
The result has the response's headers, those that a 304 reply may renew taken from the revisit.

The as-of join is split by time so that one URL may hold any share of the rows: within a (URL, time bucket) a window
finds the latest response, and a window over at most `BUCKETS` per-bucket results carries it into later buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import materialize, table

BUCKETS = 512
#: Headers that a 304 reply may send anew (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Without scheme, leading www. or m., fragment, tracking parameters and final slash; host in lower case."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z]+://", "")
    host, rest = F.lower(F.regexp_extract(u, "^[^/?]*", 0)), F.regexp_extract(u, "^[^/?]*(.*)$", 1)
    rest = F.regexp_replace(rest, "([?&])(utm_[a-z]+|ref)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "&&+", "&"), r"\?&", "?")
    rest = F.regexp_replace(rest, "[?&/]+$", "")
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), rest)


def resolve(records: DataFrame) -> DataFrame:
    """One row for each revisit of records (record_id, type, url, ts, etag, digest, headers).

    status: resolved, changed (validators disagree), or missing (no earlier full response, or no URL). Among responses of
    one time the greatest record_id is the latest. Rows that are neither type are ignored; revisits with a null time are
    missing; repeated rows are each resolved; an empty table gives an empty result; other columns are ignored. Names of
    headers are compared without regard to case.
    """
    r = records.select("record_id", "type", canonical_url(F.col("url")).alias("url"), "ts", "etag", "digest", "headers")
    r = materialize(r.where(F.col("type").isin("response", "revisit")))
    ends = r.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    lo = ends["lo"] or 0
    width = max(1, -(-((ends["hi"] or 0) - lo + 1) // BUCKETS))
    # times without a value fall into a bucket of their own rows' ids, so they never gather
    bucket = F.coalesce(F.floor((F.col("ts") - lo) / width), -1 - F.pmod(F.xxhash64("record_id"), F.lit(BUCKETS))).cast("long")
    full = (F.col("type") == "response") & F.col("ts").isNotNull()
    state = F.struct("ts", "record_id", "etag", "digest", F.to_json("headers").alias("headers"))
    r = r.withColumn("bucket", bucket).withColumn("full", F.when(full, state))
    known = r.where(F.col("url").isNotNull() & (F.col("url") != ""))
    last = known.where(full).groupBy("url", "bucket").agg(F.max("full").alias("latest"))
    before = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = known.groupBy("url", "bucket").agg(F.lit(1).alias("one")).join(last, ["url", "bucket"], "left")
    carried = materialize(buckets.select("url", "bucket", F.last("latest", ignorenulls=True).over(before).alias("carried")).where("carried is not null"))
    inside = Window.partitionBy("url", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = known.withColumn("near", F.when(F.col("ts").isNotNull(), F.max("full").over(inside))).where("type = 'revisit'")
    joined = near.join(carried, ["url", "bucket"], "left").withColumn(
        "of", F.when(F.col("ts").isNotNull(), F.coalesce("near", "carried"))
    )
    joined = joined.unionByName(
        r.where("type = 'revisit' and (url is null or url = '')").withColumn("near", F.col("full")).withColumn("carried", F.col("full")).withColumn("of", F.col("full"))
    )
    tagged = F.col("etag").isNotNull() & F.col("of.etag").isNotNull()
    mine = F.when(tagged, F.col("etag")).otherwise(F.col("digest"))
    theirs = F.when(tagged, F.col("of.etag")).otherwise(F.col("of.digest"))
    agree = mine.isNull() | theirs.isNull() | (mine == theirs)
    no_headers = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    own = F.coalesce("headers", no_headers)
    sent = F.coalesce(F.from_json("of.headers", "map<string,string>"), no_headers)
    # names of headers are alike in any case; what is sent anew stands as it was sent
    renewed = F.map_filter(own, lambda k, _: F.lower(k).isin(*PERMITTED))
    new_names = F.transform(F.map_keys(renewed), F.lower)
    merged = F.map_concat(F.map_filter(sent, lambda k, _: ~F.array_contains(new_names, F.lower(k))), renewed)
    status = F.when(F.col("of").isNull(), "missing").when(agree, "resolved").otherwise("changed")
    return joined.select(
        "record_id", "url", status.alias("status"),
        F.col("of.record_id").alias("refers_to"),
        F.when(status == "resolved", merged).alias("headers"),
    )


def records_of(pages: DataFrame) -> DataFrame:
    """A crawl as WARC records: each page is fetched in full at 2 * page_id and revisited 1001 ticks later.

    A revisit carries the validators of the fetch it followed, so it is stale where the same canonical URL was fetched
    again meanwhile with other content.
    """
    digest = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    common = [F.col("page_id").alias("record_id"), F.col("url")]
    p = pages.select("page_id", "url", digest.alias("d"), F.length(F.coalesce("html", F.lit(""))).alias("n"))
    text = lambda c: F.col(c).cast("string")
    fetched = p.select(
        *common, F.lit("response").alias("type"), (F.col("page_id") * 2).alias("ts"), F.substring("d", 1, 16).alias("etag"), F.col("d").alias("digest"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), text("n"), F.lit("etag"), F.substring("d", 1, 16), F.lit("date"), (F.col("page_id") * 2).cast("string")).alias("headers"),
    )
    again = p.select(
        *common, F.lit("revisit").alias("type"), (F.col("page_id") * 2 + 1001).alias("ts"), F.substring("d", 1, 16).alias("etag"), F.col("d").alias("digest"),
        F.create_map(F.lit("date"), (F.col("page_id") * 2 + 1001).cast("string"), F.lit("content-length"), F.lit("0")).alias("headers"),
    )
    return fetched.unionByName(again)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(records_of(table(spark, sf_dir, "pages")))
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return out.withColumn("headers", F.array_join(pairs, ";"))


SQL = r"""
WITH c AS (
  SELECT page_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z]+://', '') AS u, md5(coalesce(html, '')) AS d, length(coalesce(html, '')) AS n FROM pages
), k AS (
  SELECT page_id, d, n, regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^(www|m)\.', '') ||
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*(.*)$', 1), '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&', '?', 'g'), '[?&/]+$', '') AS url FROM c
), m AS (
  SELECT v.page_id AS record_id, v.url, v.d AS own, p.page_id AS refers_to, p.d AS theirs, p.n
  FROM k v LEFT JOIN k p ON v.url = p.url AND v.url <> '' AND p.page_id * 2 < v.page_id * 2 + 1001
  QUALIFY row_number() OVER (PARTITION BY v.page_id ORDER BY p.page_id DESC NULLS LAST) = 1
)
SELECT record_id, url, CASE WHEN refers_to IS NULL THEN 'missing' WHEN own[1:16] = theirs[1:16] THEN 'resolved' ELSE 'changed' END AS status, refers_to,
  CASE WHEN own[1:16] = theirs[1:16] THEN 'content-length=' || n || ';content-type=text/html;date=' || (record_id * 2 + 1001) || ';etag=' || theirs[1:16] END AS headers
FROM m
"""
