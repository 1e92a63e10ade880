"""Not-modified revisits of a web archive, resolved to the response they confirm.

Each revisit takes the latest earlier full response with the same canonical URL. Its
validators are checked, and the headers that a not-modified answer may change are
merged into the stored ones. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphsets.llm.store import saved, shuffle_parts

# Headers that describe the stored body or one connection; a revisit never changes them.
FIXED_HEADERS = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range",
    "content-type", "keep-alive", "transfer-encoding", "upgrade",
)
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, www and the scheme's default port (80 for http or no
    scheme, 443 for https); path without a trailing slash; parameters sorted and without
    tracking ones; no fragment. Null stays null."""
    whole = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(whole, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    bare = F.regexp_replace(whole, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    server = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), r"^www\.", "")
    host = F.when(scheme == "https", F.regexp_replace(server, ":443$", "")).when(
        scheme.isin("http", ""), F.regexp_replace(server, ":80$", "")
    ).otherwise(server)
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: ~x.rlike(TRACKING) & (x != "")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def _validators(*columns: str) -> Column:
    """A join key of the named columns, nulls told from empty ones."""
    return F.concat_ws("\n", *[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("~")) for c in columns])


def latest_responses(records: DataFrame) -> DataFrame:
    """(record_id, url_key, captured_at, etag, last_modified, headers, found) of each revisit.

    ``found`` is the struct (captured_at, record_id, etag, last_modified) of the latest
    response before it, or null. Captures are dealt into ranges of (URL, time); the last
    response of each range is handed to the URL's later ranges, so one URL may hold any
    share of the rows.
    """
    ranged = saved(
        records.select(
            "record_id", canonical_url(F.col("url")).alias("url_key"), "captured_at", "type", "etag", "last_modified",
            F.when(F.col("type") == "revisit", F.col("headers")).alias("headers"),
        )
        .repartitionByRange(shuffle_parts(records), "url_key", "captured_at")
        .withColumn("_part", F.spark_partition_id()),
        "captures",
    )
    capture = F.when(
        (F.col("type") == "response") & F.col("captured_at").isNotNull() & F.col("url_key").isNotNull() & F.col("record_id").isNotNull(),
        F.struct("captured_at", "record_id", "etag", "last_modified"),
    )
    by_part = Window.partitionBy("url_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        ranged.groupBy("url_key", "_part").agg(F.max(capture).alias("_last"))
        .select("url_key", "_part", F.max("_last").over(by_part).alias("_before"))
        .filter("_before is not null")
    )
    earlier = Window.partitionBy("url_key", "_part").orderBy("captured_at").rangeBetween(Window.unboundedPreceding, -1)
    known = F.col("captured_at").isNotNull() & F.col("url_key").isNotNull()
    return (
        ranged.join(before, ["url_key", "_part"], "left")
        .withColumn("found", F.when(known, F.coalesce(F.max(capture).over(earlier), "_before")))
        .filter(F.col("type") == "revisit")
        .select("record_id", "url_key", "captured_at", "etag", "last_modified", "headers", "found")
    )


def resolve_revisits(records: DataFrame, fixed_headers: tuple[str, ...] = FIXED_HEADERS) -> DataFrame:
    """One row for each revisit among ``records``.

    Records have record_id, url, type (``response`` or ``revisit``), captured_at (long),
    etag, last_modified, headers (map, names in lower case) and payload. ``status`` is

    - ``unmatched``: no earlier response of that URL, or URL or time is null
    - ``resolved``: the entity tags agree (weak comparison), or without a tag on both sides the dates do
    - ``changed``: they differ; nothing is merged
    - ``unchecked``: there is nothing to compare; nothing is merged

    Of responses at one time the one with the largest record_id counts, then the largest
    validators; a response at the revisit's own time is not earlier. Each revisit gives one
    row, also if record_ids repeat or are null; a response with a null record_id or time
    confirms nothing. Of responses alike in all this the smallest payload counts. Resolved
    rows carry the response's payload and the merged headers.
    """
    found = latest_responses(records).withColumn("response_id", F.col("found.record_id"))
    tags = F.col("etag").isNotNull() & F.col("found.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("found.last_modified").isNotNull()
    agree = F.when(tags, _strong(F.col("etag")) == _strong(F.col("found.etag"))).when(
        dates, F.col("last_modified") == F.col("found.last_modified")
    )
    checked = found.withColumn(
        "status",
        F.when(F.col("response_id").isNull(), "unmatched").when(agree, "resolved").when(~agree, "changed").otherwise("unchecked"),
    ).select(
        "record_id", "url_key", "captured_at", "response_id", F.col("found.captured_at").alias("response_at"), "status",
        F.col("headers").alias("_sent"), _validators("found.etag", "found.last_modified").alias("_validators"),
    )
    keys = ["response_id", "response_at", "url_key", "_validators"]
    stored = records.filter("type = 'response'").select(
        F.col("record_id").alias("response_id"), F.col("captured_at").alias("response_at"),
        canonical_url(F.col("url")).alias("url_key"), _validators("etag", "last_modified").alias("_validators"),
        F.struct(F.coalesce("payload", F.lit("")).alias("body"), F.array_sort(F.map_entries("headers")).alias("list"), "payload").alias("_body"),
    ).groupBy(*keys).agg(F.min("_body").alias("_body"))
    changes = F.map_filter(
        F.coalesce("_sent", F.create_map().cast("map<string,string>")), lambda name, _: ~F.lower(name).isin(*fixed_headers)
    )
    kept = F.map_filter(
        F.coalesce(F.map_from_entries("_body.list"), F.create_map().cast("map<string,string>")), lambda name, _: ~F.map_contains_key(changes, name)
    )
    resolved = (
        checked.filter("status = 'resolved'")
        .join(stored, keys)
        .withColumn("headers", F.map_concat(kept, changes))
        .withColumn("payload", F.col("_body.payload"))
        .drop("_body", "_sent", "_validators")
    )
    rest = checked.filter("status <> 'resolved'").drop("_sent", "_validators")
    return resolved.unionByName(rest, allowMissingColumns=True)


def page_captures(pages: DataFrame) -> DataFrame:
    """Archive records as a crawl of ``pages`` leaves them.

    Each page is captured in full and visited again a day later; each visit also asks
    the host for robots.txt, in full every tenth time. Records of a page without page_id
    have neither id nor time, so its two visits confirm nothing and are confirmed by nothing.
    """
    page, at = F.col("page_id"), F.col("page_id") * 60
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    root = F.concat(F.regexp_extract("url", "^([A-Za-z]+://[^/?#]*)", 1), F.lit("/robots.txt"))
    rule = F.concat(F.lit('"r'), F.expr("page_id div 50").cast("string"), F.lit('"'))
    robots = page % 10 == 0

    def record(number, url, kind, when, etag, modified, payload):
        headers = F.map_filter(
            F.create_map(
                F.lit("date"), when.cast("string"), F.lit("cache-control"),
                F.when(kind == "revisit", F.concat(F.lit("max-age="), (page % 100).cast("string"))).otherwise("no-cache"),
                F.lit("content-length"), F.octet_length(F.coalesce(payload, F.lit(""))).cast("string"),
            ),
            lambda _, value: value.isNotNull(),
        )
        return F.struct(
            (page * 4 + number).alias("record_id"), url.alias("url"), kind.alias("type"), when.alias("captured_at"),
            etag.alias("etag"), modified.alias("last_modified"), headers.alias("headers"), payload.alias("payload"),
        )

    none = F.lit(None).cast("string")
    again = F.when(page % 7 == 0, F.lit('"other"')).when(page % 11 == 0, none).when(page % 3 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    modified = F.when(page % 13 == 0, none).otherwise((at - 3600).cast("string"))
    full = F.when(robots, F.concat(F.lit("User-agent: *\nDisallow: /"), page.cast("string")))
    records = F.array(
        record(0, F.col("url"), F.lit("response"), at, tag, modified, F.col("html")),
        record(1, F.col("url"), F.lit("revisit"), at + 86400, again, modified, none),
        record(2, root, F.when(robots, "response").otherwise("revisit"), at + 30, rule, none, full),
    )
    return pages.select(F.explode(records).alias("r")).select("r.*")
