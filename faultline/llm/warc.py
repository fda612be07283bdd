"""Resolution of not-modified revisits in web archives.

A revisit record says that a page had not changed; it carries headers but no body. Each one is joined, as of its time, to
the latest earlier full response for the same canonical URL; its validators must agree with that response, whose body and
headers it then takes, updated by the headers that a 304 answer may change.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline.llm.common import let

#: Headers describing the stored body or the connection: a 304 answer does not change them.
KEPT = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
        "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]
BUCKET_SECONDS = 32 * 86400
#: Query parameters that name a visitor's way to a page, not the page.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid)"


def canonical(url: Column) -> Column:
    """One spelling for the URLs of a page: no scheme, user, ``www.`` or ``m.``, default port, fragment, tracking parameters,
    empty query or closing slash; host in lower case, parameters sorted. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~F.regexp_like(p, F.lit(rf"^{TRACKING}(=.*)?$"))))
    return F.concat(host, path, let(kept, lambda k: F.when(F.size(k) > 0, F.concat(F.lit("?"), F.array_join(k, "&"))).otherwise(F.lit(""))))


def lowered(headers: Column) -> Column:
    """Headers by lower-case name; of names that differ in case only the first counts, nulls are dropped, no map: none."""
    entries = F.filter(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("k"), e["value"].alias("v"))), lambda e: e["v"].isNotNull())
    first = let(entries, lambda all_: F.filter(all_, lambda e, i: F.array_position(F.transform(all_, lambda x: x["k"]), e["k"]) == i + 1))
    return F.coalesce(F.map_from_entries(first), F.create_map().cast("map<string,string>"))


def merged(stored: Column, update: Column) -> Column:
    """The stored response's headers with those of the revisit that may change (both by lower-case name)."""
    fresh = F.map_filter(update, lambda k, v: ~k.isin(KEPT))
    return let(fresh, lambda f: F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(f), k)), f))


def strong(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^[Ww]/", "")


def outcome_of(revisit: str, stored: str) -> Column:
    """``resolved``, ``validator_mismatch``, ``unverified`` (nothing on both sides to compare) or ``no_response``.

    The entity tags decide where both records have one (weak comparison), else the modification dates, else the digests.
    """
    out = F.when(F.col(f"{stored}.record_id").isNull(), "no_response")
    for name in ("etag", "last_modified", "digest"):
        a, b = F.col(f"{revisit}.{name}"), F.col(f"{stored}.{name}")
        a, b = (strong(a), strong(b)) if name == "etag" else (a, b)
        out = out.when(a.isNotNull() & b.isNotNull(), F.when(a == b, "resolved").otherwise("validator_mismatch"))
    return out.otherwise("unverified")


def latest_earlier(records: DataFrame) -> DataFrame:
    """``(r, s)``: each revisit and the latest response captured strictly before it (null if none), both without body.

    Records of a URL are cut into stretches of time. The last response of every stretch is carried forward on a table with
    a row for each URL and stretch, the exact order is then settled inside the stretch: a URL met very often is spread over
    as many tasks as its history has stretches. Of responses captured in the same second the larger record_id counts.
    """
    about = F.struct("record_id", "captured", "etag", "last_modified", "digest", lowered(F.col("headers")).alias("headers"))
    rows = records.select(canonical(F.col("url")).alias("page"), "captured", (F.col("kind") == "revisit").alias("asks"), F.struct("url", about.alias("a")).alias("both"))
    rows = rows.where(F.col("page").isNotNull() & F.col("captured").isNotNull()).withColumn("stretch", F.floor(F.col("captured") / BUCKET_SECONDS))
    rows = rows.withColumn("answer", F.when(~F.col("asks"), F.col("both.a")))
    place = F.struct("captured", "both.a.record_id")
    last = rows.groupBy("page", "stretch").agg(F.max_by("answer", F.when(~F.col("asks"), place)).alias("answer"))
    before = W.partitionBy("page").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("page", "stretch", F.last("answer", ignorenulls=True).over(before).alias("carried"))
    inside = W.partitionBy("page", "stretch").orderBy("captured", F.desc("asks"), "both.a.record_id").rowsBetween(W.unboundedPreceding, 0)
    seen = rows.withColumn("near", F.last("answer", ignorenulls=True).over(inside)).where("asks")
    return seen.join(carried, ["page", "stretch"]).select(F.col("page"), F.col("both.url").alias("url"), F.col("both.a").alias("r"), F.coalesce("near", "carried").alias("s"))


def resolved(records: DataFrame) -> DataFrame:
    """One row for each revisit: ``record_id, url, canonical_url, captured, outcome, response_id, headers, body``.

    ``records``: record_id, url, captured (seconds), kind (response or revisit), etag, last_modified, digest, headers, body.
    ``response_id`` names the latest earlier response, whatever the outcome; headers are merged and the body taken only if
    the revisit is resolved or has nothing to compare, otherwise the revisit's own headers stand and the body is null.
    Revisits without URL or time have no response. Repeated revisits are resolved each; responses repeated under one
    record_id count once. Other columns are not read; an empty table gives none.
    """
    found = latest_earlier(records.where(F.col("kind").isin("response", "revisit")))
    lost = records.where((F.col("kind") == "revisit") & (canonical(F.col("url")).isNull() | F.col("captured").isNull()))
    found = found.withColumn("outcome", outcome_of("r", "s"))
    fits = F.col("outcome").isin("resolved", "unverified")
    out = found.select(F.col("r.record_id").alias("record_id"), "url", F.col("page").alias("canonical_url"), F.col("r.captured").alias("captured"), "outcome",
                       F.col("s.record_id").alias("response_id"), F.when(fits, merged(F.col("s.headers"), F.col("r.headers"))).otherwise(F.col("r.headers")).alias("headers"),
                       F.when(fits, F.col("s.record_id")).alias("body_of"))
    none = lost.select("record_id", "url", canonical(F.col("url")).alias("canonical_url"), "captured", F.lit("no_response").alias("outcome"),
                       F.lit(None).cast(records.schema["record_id"].dataType).alias("response_id"), lowered(F.col("headers")).alias("headers"),
                       F.lit(None).cast(records.schema["record_id"].dataType).alias("body_of"))
    bodies = records.where(F.col("kind") == "response").groupBy(F.col("record_id").alias("key")).agg(F.max("body").alias("body"))
    # revisits that take no body look up their own id, so that they do not meet under one empty key
    keyed = out.union(none).withColumn("key", F.coalesce("body_of", "record_id"))
    body = F.when(F.col("body_of").isNotNull(), F.col("body")).alias("body")
    return keyed.join(bodies, "key", "left").select("record_id", "url", "canonical_url", "captured", "outcome", "response_id", "headers", body)


def crawl(pages: DataFrame) -> DataFrame:
    """Archive records derived from crawled pages: a full response for each, and a later revisit that repeats its validators.

    A page is fetched at minute ``page_id`` and asked for again 30 days later. By the remainder of page_id, the revisit
    repeats the entity tag (weakly), or only the modification date, or only the digest, or nothing, or brings another tag.
    """
    text, case = F.coalesce("html", F.lit("")), F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(5))
    tag, day, sum_ = F.concat(F.lit('"'), F.substring(F.md5(text.cast("binary")), 1, 12), F.lit('"')), F.concat(F.lit("day "), F.pmod("page_id", F.lit(365))), F.md5(text.cast("binary"))
    none = F.lit(None).cast("string")
    full = pages.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 60).alias("captured"), F.lit("response").alias("kind"),
                        tag.alias("etag"), day.alias("last_modified"), sum_.alias("digest"),
                        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length("html").cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"),
                                     F.lit("ETag"), tag).alias("headers"), F.col("html").alias("body"))
    again = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 60 + 30 * 86400).alias("captured"), F.lit("revisit").alias("kind"),
                         F.when(case == 0, F.concat(F.lit("W/"), tag)).when(case == 4, F.lit('"other"')).alias("etag"),
                         F.when(case == 1, day).alias("last_modified"), F.when(case == 2, sum_).alias("digest"),
                         F.create_map(F.lit("cache-control"), F.lit("max-age=600"), F.lit("Content-Length"), F.lit("0"), F.lit("Date"), F.concat(F.lit("minute "), F.col("page_id"))).alias("headers"), none.alias("body"))
    return full.unionByName(again)


#: The same over ``pages`` for DuckDB.
SQL = r"""WITH p AS (SELECT page_id, url, html, md5(coalesce(html, '')) AS digest, '"' || left(md5(coalesce(html, '')), 12) || '"' AS etag, 'day ' || (page_id % 365) AS modified,
      regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS bare FROM pages),
    c AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '')
      || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
      list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|ref|fbclid|gclid)(=.*)?$'))) AS params FROM p),
    k AS (SELECT *, place || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS page FROM c),
    v AS (SELECT k.*, page_id * 60 + 30 * 86400 AS asked FROM k),
    j AS (SELECT v.page_id, v.url, v.page, v.asked, v.digest AS d, v.etag AS e, v.modified AS m, s.page_id AS sid, s.etag AS se, s.modified AS sm, s.digest AS sd, s.html AS body
      FROM v ASOF LEFT JOIN k s ON v.page = s.page AND v.asked > s.page_id * 60),
    o AS (SELECT *, CASE WHEN sid IS NULL THEN 'no_response' WHEN page_id % 5 = 0 THEN CASE WHEN e = se THEN 'resolved' ELSE 'validator_mismatch' END
      WHEN page_id % 5 = 1 THEN CASE WHEN m = sm THEN 'resolved' ELSE 'validator_mismatch' END WHEN page_id % 5 = 2 THEN CASE WHEN d = sd THEN 'resolved' ELSE 'validator_mismatch' END
      WHEN page_id % 5 = 4 THEN 'validator_mismatch' ELSE 'unverified' END AS outcome FROM j)
    SELECT page_id * 2 + 1 AS record_id, url, page AS canonical_url, asked AS captured, outcome, sid * 2 AS response_id,
      CASE WHEN outcome IN ('resolved', 'unverified') THEN 'cache-control: max-age=600; content-length: ' || length(body) || '; content-type: text/html; date: minute ' || page_id || '; etag: ' || se
        ELSE 'cache-control: max-age=600; content-length: 0; date: minute ' || page_id END AS headers,
      CASE WHEN outcome IN ('resolved', 'unverified') THEN sha256(body) END AS body_sha256 FROM o"""
