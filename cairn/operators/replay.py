"""Which archived URL a replay request means: by its url parameter, by its Referer, or by its client's session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources import warc

#: Requests of a client that one group of rows holds at most, where request numbers have no repeats.
CHUNK = 1 << 20


def asked_url(request: Column) -> Column:
    """The url parameter of a request for the replay page, decoded; null if there is none, or it is empty or cannot be decoded."""
    value = F.regexp_extract(request, r"/replay\?(?:[^#]*&)?url=([^&#]*)", 1)
    return F.nullif(F.try_url_decode(value), F.lit(""))


def targets(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """log (client_id, request_no, request, referer) with target and resolved_by.

    URL: the request names its target. REFERER: a relative request, against the page that its Referer names. SESSION: a relative request without such a
    Referer, against the last page that the client had asked for by URL. NONE: there is no such page, or the replay page is asked for without a target.
    The last page is found per client and chunk of request numbers first, then over the chunks of a client (one row each), so a client of any number of
    requests is not one task's work. Null clients have no session."""
    page = F.regexp_extract("request", r"^([^?#]*)", 1) == "/replay"
    named = F.when(page, asked_url(F.col("request")))
    rows = log.withColumns({"_named": named, "_base": asked_url(F.col("referer")), "_page": page, "_chunk": F.floor(F.col("request_no") / chunk)})
    inside = Window.partitionBy("client_id", "_chunk").orderBy("request_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_last", F.last("_named", True).over(inside))
    ends = rows.filter(F.col("_named").isNotNull() & F.col("client_id").isNotNull()).groupBy("client_id", "_chunk").agg(F.max_by("_named", "request_no").alias("_end"))
    starts = rows.filter("client_id IS NOT NULL").select("client_id", "_chunk").distinct().join(ends, ["client_id", "_chunk"], "left")
    before = Window.partitionBy("client_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("client_id", "_chunk", F.last("_end", True).over(before).alias("_before")).filter("_before IS NOT NULL")
    rows = rows.join(starts, ["client_id", "_chunk"], "left")
    session = F.when(F.col("client_id").isNotNull(), F.coalesce("_last", "_before"))
    relative = F.col("request").startswith("/") & ~F.col("_page")
    by = F.when(F.col("_named").isNotNull(), "URL").when(relative & F.col("_base").isNotNull(), "REFERER").when(relative & session.isNotNull(), "SESSION").otherwise("NONE")
    rows = rows.withColumns({"resolved_by": by, "_against": F.coalesce("_base", session)})
    target = F.when(F.col("resolved_by") == "URL", F.col("_named")).when(F.col("resolved_by") != "NONE", urls.resolved(F.col("_against"), F.col("request")))
    return rows.withColumn("target", target).select(*log.columns, "target", "resolved_by")


def answered(log: DataFrame, index: DataFrame) -> DataFrame:
    """Each request of log (client_id, request_no, request, referer) with its target, how it was found, and the archived resource that answers it."""
    found = targets(log)
    hits = warc.replayed(found.filter("target IS NOT NULL").select("request_no", F.col("target").alias("url")), index)
    rows = found.join(hits.select("request_no", "norm_uri", "status_code", "outcome"), "request_no", "left")
    return rows.withColumns({"status_code": F.coalesce("status_code", F.lit(404)), "outcome": F.coalesce("outcome", F.lit("INVALID_REQUEST"))})
