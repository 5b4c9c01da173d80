"""Not-modified revisit records, resolved against earlier captures.

A revisit record of status 304 has no payload: it stands for the latest full response (200) of
the same canonical URL before it. That is an as-of join: a running maximum over the records of a
URL in order of time, in chunks of time for URLs of very many records. A revisit is resolved if
its validators do not contradict those of the response; it then has the response's payload and
headers, updated by those of its own headers that a 304 may update.

Everything is DataFrame functions; no record meets more than its own predecessor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.operators.scan import running_before

# Headers of a 304 that do not replace stored ones (RFC 9111, sections 3.1 and 3.2).
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection",
    "te", "trailer", "transfer-encoding", "upgrade",
)
# Fixed value: begin of the names of query parameters that do not tell pages apart.
TRACKING = "utm_"

_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host in small letters without ``www.`` and default port, path without slashes at its end, sorted
    query without tracking parameters. Scheme and fragment go. Null if there is no host."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, _URL, 2), "/+$", "")
    given = F.split(F.regexp_extract(url, _URL, 3), "&")
    query = F.array_join(F.array_sort(F.filter(given, lambda x: (x != "") & ~x.startswith(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def header_map(block: Column) -> Column:
    """The headers of an HTTP head as a map; names in small letters, repeated ones joined by commas."""
    lines = F.filter(F.split(block, r"\r?\n"), lambda line: F.locate(":", line) > 1)
    name = lambda line: F.lower(F.trim(F.substring_index(line, ":", 1)))
    value = lambda line: F.trim(F.substr(line, F.locate(":", line) + 1))
    names = F.array_distinct(F.transform(lines, name))
    values = F.transform(names, lambda wanted: F.array_join(F.transform(F.filter(lines, lambda line: name(line) == wanted), value), ", "))
    return F.map_from_arrays(names, values)


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def validators_agree(own: Column, stored: Column) -> Column:
    """Entity tags are compared if both have one (weakly), else dates of last change if both have one; else nothing contradicts."""
    tags = own["etag"].isNotNull() & stored["etag"].isNotNull()
    dates = own["last-modified"].isNotNull() & stored["last-modified"].isNotNull()
    return F.when(tags, _strong(own["etag"]) == _strong(stored["etag"])).when(dates, own["last-modified"] == stored["last-modified"]).otherwise(True)


def merged(stored: Column, own: Column) -> Column:
    """The stored headers, updated by the permitted ones of a 304."""
    update = F.map_filter(own, lambda name, _: ~name.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda name, _: ~F.map_contains_key(update, name)), update)


def resolve(records: DataFrame, chunk: str = "1 day") -> DataFrame:
    """Every record with its ``outcome``, the record it ``refers_to`` and its effective ``headers``.

    ``records`` has ``record_id`` (long), ``url``, ``at`` (timestamp), ``status`` (200 is a full
    response, 304 a revisit) and ``head`` (the HTTP head as text); other columns are ignored.
    Earlier means a smaller ``(at, record_id)``. Outcomes: ``full``; ``resolved``; ``changed``
    (the validators contradict), ``missing`` (no earlier response, or no URL, time or id to find
    one by), both with the record's own headers; ``other`` for any other status. A null head
    has no headers. Rows that repeat an id are records each; of responses with equal time and
    id the one whose head sorts first is referred to.
    """
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("url"), F.col("at"),
        F.col("status").cast("int").alias("status"), F.coalesce("head", F.lit("")).alias("head"),
    )
    placed = F.col("url").isNotNull() & F.col("at").isNotNull() & F.col("record_id").isNotNull()
    own = F.when(F.col("status") == 200, F.struct("at", "record_id"))
    found = running_before(rows.filter(placed), ["url"], [("at", chunk), "record_id"], {"latest": ("max", own)})
    found = found.unionByName(rows.filter(~placed), allowMissingColumns=True)
    revisits, others = found.filter("status = 304"), found.filter("status is null or status <> 304")
    # the responses once more, by what revisits refer to
    stored = rows.filter(placed & (F.col("status") == 200)).groupBy(F.col("url").alias("_1"), F.struct("at", "record_id").alias("_2")).agg(F.min("head").alias("stored"))
    joined = revisits.join(stored, (revisits["url"] == stored["_1"]) & (revisits["latest"] == stored["_2"]), "left")
    joined = joined.withColumns({"own": header_map(F.col("head")), "stored": header_map(F.col("stored"))})
    agree = validators_agree(F.col("own"), F.col("stored"))
    outcome = F.when(F.col("stored").isNull(), "missing").when(agree, "resolved").otherwise("changed")
    joined = joined.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    columns = ("record_id", "url", "at", "status")
    first = joined.select(
        *columns, "outcome", F.when(resolved, F.col("latest.record_id")).alias("refers_to"),
        F.when(resolved, merged(F.col("stored"), F.col("own"))).otherwise(F.col("own")).alias("headers"),
    )
    second = others.select(
        *columns, F.when(F.col("status") == 200, "full").otherwise("other").alias("outcome"),
        F.lit(None).cast("long").alias("refers_to"), header_map(F.col("head")).alias("headers"),
    )
    return first.unionByName(second)


def crawl_of(pages: DataFrame) -> DataFrame:
    """Records of a crawl of ``pages``: each page fetched, fetched again a day later, and the
    ``robots.txt`` of its host asked for, which is sent in full only now and then."""
    number, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    line = lambda *parts: F.concat(F.lit("\r\n"), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    tag = F.concat(F.lit('"'), F.md5(html), F.lit('"'))
    version = F.concat(F.lit('"r'), F.floor(number / 5000).cast("string"), F.lit('"'))
    day = 86_400
    full = F.concat(
        F.lit("HTTP/1.1 200 OK"), line("Content-Type: text/html; charset=utf-8"), line("Content-Length: ", F.octet_length(html)),
        line("ETag: ", tag), line("Date: ", number), line("Cache-Control: max-age=60"),
    )
    again = F.concat(
        F.lit("HTTP/1.1 304 Not Modified"),
        F.when(number % 4 == 1, line('ETag: "changed"')).when(number % 4 == 2, F.lit("")).otherwise(line("ETag: W/", tag)),
        line("Date: ", number + day), line("Cache-Control: max-age=3600"), line("Content-Length: 0"), line("Connection: close"),
    )
    sent = number % 50 == 0
    robots = F.concat(
        F.when(sent, "HTTP/1.1 200 OK").otherwise("HTTP/1.1 304 Not Modified"),
        F.when(sent, line("Content-Type: text/plain")).otherwise(F.lit("")), line("ETag: ", version), line("Date: ", number),
    )
    site = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)

    def record(kind: int, url: Column, late: int, status: Column, head: Column) -> Column:
        at = F.timestamp_seconds(F.lit(1_704_067_200 + late) + number)
        return F.struct((number * 3 + kind).alias("record_id"), url.alias("url"), at.alias("at"), status.alias("status"), head.alias("head"))

    return pages.select(F.inline(F.array(
        record(0, F.col("url"), 0, F.lit(200), full),
        record(1, F.col("url"), day, F.lit(304), again),
        record(2, F.concat(site, F.lit("/robots.txt")), 0, F.when(sent, 200).otherwise(304), robots),
    )))
