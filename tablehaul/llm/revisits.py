"""Not-modified revisit records of web archives: which earlier response they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablehaul.llm.columns import ascii_lower, let
from tablehaul.operators.merge import one_per_key
from tablehaul.operators.skew import join_per_key

# Headers that a not-modified answer may renew, and query parameters that name a visit and not a page.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
VISIT_PARAMETERS = r"^(utm_[a-z]+|gclid|fbclid|sessionid|phpsessid|jsessionid)(=|$)"

#: Length of the time buckets that a url's records are split by.
BUCKET_SECONDS = 3600


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no default port, fragment, login or visit parameters; the others sorted; never an empty path.

    A null url, and one without ``://``, stays as it is.
    """
    part = lambda n: F.regexp_extract(url, r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?", n)
    scheme = ascii_lower(part(1))
    named = F.regexp_replace(ascii_lower(part(2)), r"^.*@", "")
    cut = lambda port: F.regexp_replace(named, f":({port})?$", "")
    host = F.when(scheme == "http", cut("80")).when(scheme == "https", cut("443")).otherwise(cut(""))
    params = F.array_sort(F.filter(F.split(F.substring(part(4), 2, 1 << 30), "&", -1), lambda p: (p != "") & ~ascii_lower(p).rlike(VISIT_PARAMETERS)))
    query = let(params, lambda p: F.when(F.size(p) > 0, F.concat(F.lit("?"), F.array_join(p, "&"))).otherwise(F.lit("")))
    path = F.when(part(3) == "", F.lit("/")).otherwise(part(3))
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host, path, query)).otherwise(url)


def lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that then clash the last in order of spelling counts. Null counts as none."""
    pairs = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    sorted_pairs = F.array_sort(pairs.cast("array<struct<key:string,value:string>>"))
    folded = F.transform(sorted_pairs, lambda e: F.struct(ascii_lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = let(folded, lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda later: later["key"] == e["key"])))
    return F.map_from_entries(last)


def _weak(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), r"^W/", "")


def resolve(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS, payload: bool = True) -> DataFrame:
    """One row per revisit of ``records`` (record_id, kind, url, date, status, headers, digest, payload).

    A full response is a record of kind ``response`` with status 200, a revisit one
    of kind ``revisit``. Each revisit meets the latest response of the same canonical
    url with an earlier date (of equal dates the greatest record_id). ``outcome``:

    * ``resolved``: ETags match (weak comparison), or without both Last-Modified does, or without both the digest does;
    * ``mismatch``: the first of these that both records have differs;
    * ``unchecked``: they share no validator;
    * ``orphan``: no earlier response. Also for a null url or date.

    Resolved and unchecked revisits get status, payload and the response's headers
    renewed by the revisit's ``PERMITTED`` ones; others get null. Repeated revisits
    give a row each; repeated responses count once. Of responses that share id and
    date but not content, the one with the greatest digest, validators and payload
    counts, null last; a shared id at another date is another response.

    The as-of search runs in buckets of url and time: inside a bucket by a window,
    before it by one row per bucket. So a url with a third of all records is spread
    over its time span. Headers and payloads are joined at the end, by a join that
    splits hot responses.
    """
    rows = records.select(
        "record_id", "kind", "date", "status", lower_names(F.col("headers")).alias("headers"), "digest", canonical(F.col("url")).alias("key"),
        *(["payload"] if payload else []),
    )
    rows = rows.withColumn("bucket", F.floor(F.unix_timestamp("date") / F.lit(bucket_seconds)))
    placed = F.col("key").isNotNull() & F.col("date").isNotNull()
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("record_id").isNotNull() & placed
    known = F.struct(
        "date", "record_id", F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified"), "digest"
    )
    validators = {"_etag": F.col("headers")["etag"], "_modified": F.col("headers")["last-modified"]}
    answers = rows.where(full).withColumns(validators)
    same = ["record_id", "date"]
    by_content = ["digest", "_etag", "_modified"]
    responses = one_per_key(answers, same, [*by_content, *(["payload"] if payload else [])])
    revisits = rows.where(F.col("kind") == "revisit")

    events = one_per_key(answers.drop("payload"), same, by_content).select("key", "bucket", "date", F.lit(1).alias("turn"), F.col("record_id").alias("id"), known.alias("found"), F.lit(None).cast(revisits.schema["headers"].dataType).alias("headers"), F.lit(None).cast("string").alias("own_digest"))
    asked = revisits.select("key", "bucket", "date", F.lit(0).alias("turn"), F.col("record_id").alias("id"), F.lit(None).cast(events.schema["found"].dataType).alias("found"), "headers", F.col("digest").alias("own_digest"))
    both = events.unionByName(asked.where("key is not null and date is not null"))

    # in the bucket: revisits come before responses of the same date
    inside = Window.partitionBy("key", "bucket").orderBy("date", "turn", "id").rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.last("found", ignorenulls=True).over(inside)).where("turn = 0")
    # before the bucket: the last response of every bucket, carried on
    per_bucket = both.groupBy("key", "bucket").agg(F.max("found").alias("last"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select("key", "bucket", F.last("last", ignorenulls=True).over(before).alias("far"))
    met = join_per_key(near, carried, ["key", "bucket"], "left")
    met = met.select("key", "date", "id", "headers", "own_digest", F.coalesce("near", "far").alias("found"))
    lost = revisits.where("key is null or date is null").select("key", "date", F.col("record_id").alias("id"), "headers", F.col("digest").alias("own_digest"), F.lit(None).cast(events.schema["found"].dataType).alias("found"))
    all_met = met.unionByName(lost)

    etag, modified = F.col("headers")["etag"], F.col("headers")["last-modified"]
    checks = F.coalesce(
        F.when(etag.isNotNull() & F.col("found.etag").isNotNull(), _weak(etag) == _weak(F.col("found.etag"))),
        F.when(modified.isNotNull() & F.col("found.modified").isNotNull(), modified == F.col("found.modified")),
        F.when(F.col("own_digest").isNotNull() & F.col("found.digest").isNotNull(), F.col("own_digest") == F.col("found.digest")),
    )
    outcome = (
        F.when(F.col("found").isNull(), "orphan").when(checks, "resolved").when(~checks, "mismatch").otherwise("unchecked")
    )
    judged = all_met.withColumn("outcome", outcome).withColumn("ref", F.when(F.col("outcome").isin("resolved", "unchecked"), F.col("found.record_id"))).withColumn("ref_date", F.col("found.date"))
    stored = responses.select(F.col("record_id").alias("ref"), F.col("date").alias("ref_date"), F.col("headers").alias("stored"), "status", *(["payload"] if payload else []))
    joined = join_per_key(judged, stored, ["ref", "ref_date"])
    renewed = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = let(renewed, lambda new: F.map_concat(F.map_filter("stored", lambda k, v: ~F.array_contains(F.map_keys(new), k)), new))
    return joined.select(
        F.col("id").alias("record_id"), F.col("key").alias("url"), "date", "outcome", F.col("found.record_id").alias("refers_to"),
        F.col("found.date").alias("refers_to_date"), F.when(F.col("ref").isNotNull(), F.col("status")).alias("status"),
        F.when(F.col("ref").isNotNull(), merged).alias("headers"), *(["payload"] if payload else []),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Records derived from ``pages`` (page_id, url, html): a response of each page, and a revisit of it.

    Page n is fetched in minute n of 2024 and asked for again six hours to two days
    later, every eleventh an hour before, so that another capture or none answers.
    Every seventh revisit carries another ETag; every fifth page has none and is
    checked by date; every thirteenth only by digest; every seventeenth by nothing.
    """
    n = F.coalesce(F.col("page_id"), F.lit(0))
    at = F.timestamp_seconds(F.lit(1704067200) + n * 60)
    again = F.timestamp_seconds(F.lit(1704067200) + n * 60 + F.when(n % 11 == 0, -3600).otherwise(21600 + (n % 50) * 3600))
    digest = F.md5(F.coalesce("html", F.lit("")))
    etag = F.when((n % 5 != 0) & (n % 13 != 0) & (n % 17 != 0), F.concat(F.lit('"'), F.left(digest, F.lit(12)), F.lit('"')))
    modified = F.when((n % 13 != 0) & (n % 17 != 0), F.date_format(F.to_timestamp_ntz(F.lit("2023-12-31 00:00:00")), "yyyy-MM-dd"))
    headers = lambda *pairs: F.map_filter(F.create_map(*[x for p in pairs for x in p]), lambda k, v: v.isNotNull())
    response = pages.select(
        F.concat(F.lit("response-"), F.col("page_id").cast("string")).alias("record_id"), F.lit("response").alias("kind"), "url", at.alias("date"), F.lit(200).alias("status"),
        headers((F.lit("ETag"), etag), (F.lit("Last-Modified"), modified), (F.lit("Content-Type"), F.lit("text/html")), (F.lit("Cache-Control"), F.lit("max-age=60"))).alias("headers"),
        F.when(n % 17 != 0, digest).alias("digest"), F.col("html").alias("payload"),
    )
    changed = F.when(etag.isNotNull(), F.when(n % 7 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), etag)))
    revisit = pages.select(
        F.concat(F.lit("revisit-"), F.col("page_id").cast("string")).alias("record_id"), F.lit("revisit").alias("kind"),
        F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"), again.alias("date"), F.lit(304).alias("status"),
        headers((F.lit("etag"), changed), (F.lit("Last-Modified"), modified), (F.lit("Cache-Control"), F.lit("max-age=600")), (F.lit("Set-Cookie"), F.lit("x=1"))).alias("headers"),
        F.when(n % 17 != 0, digest).alias("digest"), F.lit(None).cast("string").alias("payload"),
    )
    return response.unionByName(revisit)


def revisit_rows(pages: DataFrame) -> DataFrame:
    """One row per revisit: what it stands for, how that was checked, the merged headers and the payload's digest."""
    found = resolve(captures(pages.select("page_id", "url", "html")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"]))), "\n")
    return found.select(
        "record_id", "url", F.unix_timestamp("date").alias("at"), "outcome", "refers_to", F.unix_timestamp("refers_to_date").alias("refers_to_at"),
        "status", lines.alias("headers"), F.sha2("payload", 256).alias("payload_sha256"),
    )
