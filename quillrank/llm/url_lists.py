"""URL filters by dated lists: each capture is judged by the entries that were active when it was fetched.

List events (add, remove) become validity intervals, and an as-of join meets every capture with the interval of each
of its keys - the host and its parent domains, the host with its leading path segments - that holds its fetch day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.operators.placement import fits_broadcast
from quillrank.session import settled

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
BUCKET_DAYS = 64


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty where there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), HOST, 1), r"\.+$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def intervals(events: DataFrame) -> DataFrame:
    """(list, kind, pattern, valid_from, valid_to) of events (list, kind, pattern, day, action).

    `kind` is `domain` (the host and all below it) or `prefix` (host and leading path segments). An entry holds from
    the day of its `add` until the day before its next event; valid_to is null while it still holds. Of several
    events on one day a `remove` wins. Rows with a null in one of the five columns, or other actions, say nothing.
    Days are folded first, so what a pattern sorts is bounded by the number of days.
    """
    known = events.select("list", "kind", "pattern", "day", "action").dropna().where(F.col("action").isin("add", "remove"))
    key = ["list", "kind", "pattern"]
    days = known.groupBy(*key, "day").agg(F.max(F.col("action") == "remove").alias("gone"))
    following = Window.partitionBy(*key).orderBy("day")
    spans = days.withColumn("valid_to", F.lead("day").over(following)).where(~F.col("gone"))
    return spans.select(*key, F.col("day").alias("valid_from"), "valid_to")


def keys_of(host: Column, path: Column, depth: int) -> Column:
    """The patterns that cover a URL: its domains, and its host with up to `depth` leading path segments."""
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")),
    )
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    most = F.least(F.size(segments), F.lit(depth))
    prefixes = F.when(
        most > 0,
        F.transform(
            F.sequence(F.lit(1), F.greatest(most, F.lit(1))),
            lambda i: F.struct(
                F.lit("prefix").alias("kind"),
                F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")).alias("pattern"),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<kind:string,pattern:string>>"))
    return F.concat(domains, prefixes)


def evaluate(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day") -> DataFrame:
    """(id, url, day, host, n_entries, lists, pattern, blocked) of each distinct capture.

    `lists` are the names of the lists with an entry that is active on the capture's day, sorted and joined by
    commas; `pattern` is the longest such entry (ties: the smallest); `blocked` says whether there is one. A capture
    whose URL is null or has no host, or whose day is null, matches nothing. Captures that repeat (same id, URL and
    day) are one. Only the named columns are read.

    Keys that no list names go first. Then the distinct (key, day) pairs of all captures meet the intervals, by key and by a bucket of days that
    bounds how many intervals a key offers; so a host with a large share of the captures counts once per day. Only
    pairs with an active entry go on to meet the captures.
    """
    spans = intervals(events)
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(day_col).alias("day")).distinct()
    rows = rows.withColumn("host", host_of(F.coalesce("url", F.lit(""))))
    slashes = F.size(F.split("pattern", "/")) - 1
    bounds = spans.where("kind = 'prefix'").agg(F.coalesce(F.max(slashes), F.lit(0)).alias("depth")).first()
    asked = rows.where((F.col("host") != "") & F.col("day").isNotNull()).withColumn(
        "key", F.explode(keys_of(F.col("host"), path_of(F.col("url")), bounds["depth"]))
    )
    # Keys that no list knows go before anything is shuffled: the top-level domain of every capture among them.
    known = spans.select("kind", "pattern").distinct()
    known = settled(known, "known")
    asked = asked.select("id", "url", "day", "key.kind", "key.pattern")
    asked = asked.join(F.broadcast(known) if fits_broadcast(known) else known, ["kind", "pattern"], "left_semi")
    range_ = rows.agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
    first, last = F.lit(range_["first"]).cast("date"), F.lit(range_["last"]).cast("date")
    place = lambda day: F.floor(F.datediff(day, first) / BUCKET_DAYS)
    until = F.least(F.coalesce(F.date_sub("valid_to", 1), last), last)
    since = F.greatest("valid_from", first)
    dealt = spans.where(since <= until).withColumn("bucket", F.explode(F.sequence(place(since), place(until))))
    days = asked.select("kind", "pattern", "day").distinct().withColumn("bucket", place(F.col("day")))
    active = days.join(dealt, ["kind", "pattern", "bucket"]).where(
        (F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    )
    active = active.groupBy("kind", "pattern", "day").agg(F.collect_set("list").alias("names"))
    hits = asked.join(active, ["kind", "pattern", "day"])
    order = F.struct((-F.length("pattern")).alias("size"), F.col("pattern").alias("p"))
    found = hits.groupBy("id", "url", "day").agg(
        F.sum(F.size("names")).alias("n_entries"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))), ",").alias("lists"),
        F.min(order)["p"].alias("pattern"),
    )
    joined = rows.alias("r").join(
        found.alias("f"),
        F.col("r.id").eqNullSafe(F.col("f.id")) & (F.col("r.url") == F.col("f.url")) & (F.col("r.day") == F.col("f.day")),
        "left",
    )
    n = F.coalesce(F.col("n_entries"), F.lit(0).cast("long"))
    return joined.select(
        F.col("r.id").alias(id_col), F.col("r.url").alias(url_col), F.col("r.day").alias(day_col), "r.host",
        n.alias("n_entries"), F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("pattern", F.lit("")).alias("pattern"),
        (n > 0).alias("blocked"),
    )
