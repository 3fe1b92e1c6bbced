"""Request analytics over an event log: totals, nearest-rank percentiles, groups, rings, windows and cursors.

The log is (event_id, ts, user_id, event_type, value, props); value is the duration, event_type the path, and type ``error`` a failed request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.session import cut

# Names of headers, and of fields, that hold secrets.
SECRET_HEADERS = ["authorization", "x-dashboard-token", "cookie", "x-goog-api-key"]
SECRET_FIELDS = r"(?i)^(api[_-]?key|token|secret|password|authorization)$"


def _failed() -> Column:
    return F.col("event_type") == "error"


def totals(events: DataFrame) -> DataFrame:
    """count, errors, error_rate, avg_value and max_value; zeros for an empty log."""
    row = events.agg(F.count("*").alias("n"), F.count_if(_failed()).alias("errors"), F.avg("value").alias("avg"), F.max("value").alias("max"))
    rate = F.when(F.col("n") == 0, 0.0).otherwise(F.round(F.col("errors") / F.col("n"), 6))
    return row.select("n", "errors", rate.alias("error_rate"), F.round(F.coalesce("avg", F.lit(0.0)), 2).alias("avg_value"), F.round(F.coalesce("max", F.lit(0.0)), 2).alias("max_value"))


def percentiles(events: DataFrame, *by: str) -> DataFrame:
    """p50, p95 and p99 by nearest rank, for the whole log or by group.

    Values are counted first and the counts sorted into ranges, one a task. The sizes of the ranges (one row for each range and group) tell in which of them
    a rank lies, and only there values are counted on to it.
    """
    rows = events.where("value IS NOT NULL").select(F.struct(*by, F.lit(0).alias("_")).alias("g"), "value")
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy("g", "value").agg(F.count("*").alias("n")).repartitionByRange(parts, "g", "value")
    placed = cut(counts.withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy("g").orderBy("part")
    sizes = placed.groupBy("g", "part").agg(F.sum("n").alias("size"))
    sizes = sizes.withColumns({"before": F.sum("size").over(order) - F.col("size"), "total": F.sum("size").over(Window.partitionBy("g"))})
    wanted = sizes.withColumn("p", F.explode(F.array(*map(F.lit, (50, 95, 99))))).withColumn("rank", F.ceil(F.col("p") * F.col("total") / 100) - F.col("before"))
    wanted = wanted.where("rank > 0 AND rank <= size").select("g", "part", "p", "rank")
    upto = F.sum("n").over(Window.partitionBy("g", "part", "p").orderBy("value"))
    found = placed.join(wanted, ["g", "part"]).withColumn("upto", upto).where(F.col("upto") >= F.col("rank")).groupBy("g", "p").agg(F.min("value").alias("value"))
    values = [F.round(F.max(F.when(F.col("p") == p, F.col("value"))), 2).alias(f"p{p}") for p in (50, 95, 99)]
    return found.groupBy("g").agg(*values).select(*[F.col(f"g.{c}").alias(c) for c in by], "p50", "p95", "p99")


def by_group(events: DataFrame, *by: str) -> DataFrame:
    """count, errors, total, max and mean value of each group."""
    sums = events.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(_failed()).alias("errors"), F.sum("value").alias("total"), F.max("value").alias("max_value"))
    return sums.withColumn("avg_value", F.round(F.col("total") / F.col("n"), 2)).withColumn("total", F.round("total", 2))


def last_n(events: DataFrame, n: int, *by: str) -> DataFrame:
    """The last n events (of each group), newest first: what a ring of n places holds. Without groups a sorted limit, which each task cuts down first."""
    if not by:
        return events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)
    order = Window.partitionBy(*by).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return events.withColumn("age", F.row_number().over(order)).where(F.col("age") <= n)


def recent(events: DataFrame, minutes: int, as_of: str) -> DataFrame:
    """Events of the last minutes before a given moment."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return events.where((F.col("ts") >= end - F.expr(f"interval {int(minutes)} minutes")) & (F.col("ts") <= end))


def since(events: DataFrame, cursor: int, path: str | None = None, most: int = 100) -> DataFrame:
    """Up to ``most`` of the newest events after a cursor, if given only those whose type holds a text."""
    rows = events.where(F.col("event_id") > cursor)
    if path:
        rows = rows.where(F.col("event_type").contains(path))
    return rows.orderBy(F.col("event_id").desc()).limit(most)


def numbered(events: DataFrame, by: str = "user_id") -> DataFrame:
    """The number of each event within its group, from 1."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(by).orderBy("ts", "event_id")))


def latest(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The last event of each key, its first and last time and how many it has: the state that a keyed store would hold."""
    rank = F.struct("ts", "event_id")
    return events.groupBy(key).agg(F.max_by("event_type", rank).alias("last_type"), F.max_by("event_id", rank).alias("last_event"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def expired(state: DataFrame, minutes: int, as_of: str) -> DataFrame:
    """Keys whose last event is older than their time to live."""
    return state.where(F.col("last_ts") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(minutes)} minutes"))


def per_window(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Count, errors and mean value by window of time and type."""
    w = F.window(F.col("ts").cast("timestamp"), width)
    rows = events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_if(_failed()).alias("errors"), F.sum("value").alias("total"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "errors", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", by: str = "user_id") -> DataFrame:
    """Sessions of each key: events with less than the gap between them."""
    w = F.session_window(F.col("ts").cast("timestamp"), gap)
    rows = events.groupBy(by, w.alias("w")).agg(F.count("*").alias("n"))
    return rows.select(by, F.date_format("w.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"), "n")


def most_frequent(events: DataFrame, by: str, n: int = 10) -> DataFrame:
    """The n groups with most events; ties in the order of their names."""
    return events.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), by).limit(n)


def reached(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The kinds of events that each key has had, and whether any failed. There are few kinds."""
    return events.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("reached"), F.coalesce(F.bool_or(_failed()), F.lit(False)).alias("failed"))


def of_class(events: DataFrame, code: Column, first: int, words: str | None = None, most: int = 100) -> DataFrame:
    """The newest events whose code begins with a digit, if given only those whose type holds a text in any case."""
    rows = events.where(F.floor(code / 10) == first)
    if words:
        rows = rows.where(F.lower("event_type").contains(words.lower()))
    return rows.orderBy(F.col("event_id").desc()).limit(most)


def in_state(state: DataFrame, last_type: str, most: int = 20) -> DataFrame:
    """The keys whose last event is of a type, the newest first."""
    return state.where(F.col("last_type") == last_type).orderBy(F.col("last_ts").desc(), "last_event").limit(most)


def capped(column: Column, most: int) -> Column:
    """JSON text within a limit; longer ones as {"_truncated":true,"_originalChars":n,"preview":...}."""
    brief = F.to_json(F.struct(F.lit(True).alias("_truncated"), F.length(column).alias("_originalChars"), F.left(column, F.lit(most)).alias("preview")))
    return F.when(F.length(column) > most, brief).otherwise(column)


def redacted(values: Column, mask: str = "••••••••", most: int = 4000, headers: bool = False) -> Column:
    """A map of text without secrets: values under secret names masked, overlong ones elided. Headers and fields have secret names of their own."""
    secret = (lambda k: F.lower(k).isin(SECRET_HEADERS)) if headers else (lambda k: k.rlike(SECRET_FIELDS))
    elided = lambda v: F.concat(F.lit("["), F.length(v).cast("string"), F.lit(" chars elided]"))
    return F.transform_values(values, lambda k, v: F.when(secret(k), mask).when(F.length(v) > most, elided(v)).otherwise(v))
