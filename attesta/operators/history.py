"""History of changing attributes: every version of an entity with the time from which and until which it was valid.

Raw changes are snapshots (all fields) or updates (changed fields only), late, repeated and out of order. ``build_history`` makes whole chains of versions;
``rebuild_affected`` takes a batch of late or corrected changes, reads the raw changes of the touched entities only, rebuilds all their intervals and puts
the new chains in place of the old ones. ``ChainStore`` keeps chains in files and swaps the touched ones in one step.

An entity may hold any share of all rows: its chain is cut into time slices of bounded size, each slice is reduced to what it carries over (the last value
set in each field), and only these summaries are scanned in order. ``ChangeLog`` keeps raw changes by entity.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.session import cut, shared_dir

#: What stands for "no value" in a snapshot.
NO_VALUE = ("", "-")
#: Notations of a date, tried in this order; the day comes before the month where the year is last.
DATE_FORMATS = {
    r"^\d{4}-\d{1,2}-\d{1,2}": "yyyy-M-d",
    r"^\d{4}/\d{1,2}/\d{1,2}": "yyyy/M/d",
    r"^\d{8}$": "yyyyMMdd",
    r"^\d{1,2}-\d{1,2}-\d{4}$": "d-M-yyyy",
    r"^\d{1,2}/\d{1,2}/\d{4}$": "d/M/yyyy",
    r"^\d{1,2}\.\d{1,2}\.\d{4}$": "d.M.yyyy",
    r"^\d{1,2} [A-Za-z]{4,} \d{4}$": "d MMMM yyyy",
    r"^\d{1,2} [A-Za-z]{3} \d{4}$": "d MMM yyyy",
}
#: White space as in Unicode.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def squashed(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, f"{SPACE}+", " "))


def date_value(column: Column) -> Column:
    """A date in any of DATE_FORMATS as yyyy-MM-dd; other text is kept, squashed and in lower case."""
    text = squashed(column)
    out = F.lower(text)
    for pattern, layout in reversed(DATE_FORMATS.items()):
        shown = F.regexp_extract(text, pattern, 0) if not pattern.endswith("$") else F.initcap(text)
        out = F.when(text.rlike(pattern), F.coalesce(F.date_format(F.try_to_timestamp(shown, F.lit(layout)), "yyyy-MM-dd"), F.lower(text))).otherwise(out)
    return out


def status_value(column: Column) -> Column:
    """A status without regard to case, outer blanks and how its words are joined."""
    return F.regexp_replace(F.lower(squashed(column)), r"[ _-]+", "_")


def name_value(column: Column) -> Column:
    return F.lower(squashed(column))


FIELDS = {"status": status_value, "effective_from": date_value, "effective_to": date_value, "struck_down_by": name_value}


def changes(
    raw: DataFrame,
    entity: Sequence[str] = ("doc_id", "ref_key"),
    fields: dict = FIELDS,
    at: str = "recorded_at",
    order: str = "update_id",
    kind: str = "row_kind",
    arrived: str | None = "arrived_at",
) -> DataFrame:
    """One change per entity and moment: the row with the largest ``order`` (of its repeats, the one that arrived last).

    Each field becomes a struct {v} that is null where the change leaves the field as it is, and holds null where it removes the value. Rows without an
    entity key or time are left out, as they belong to no chain; a null ``order`` comes last.
    """
    rank = [F.coalesce(F.col(order).cast("long"), F.lit(-(2**63)))] + ([F.col(arrived)] if arrived else [])
    rows = raw.where(F.col(at).isNotNull())
    for key in entity:
        rows = rows.where(F.col(key).isNotNull())
    # Ties are settled by the content as well, so that the result never depends on the order of rows. Only the rows that count are cleaned.
    last = F.max(F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], F.col(kind).alias("kind"), *[F.col(n).alias(f"f_{n}") for n in fields])).alias("last")
    rows = rows.groupBy(*entity, F.col(at).alias("at")).agg(last)
    snapshot = F.coalesce(F.lower(F.col("last.kind")) == "snapshot", F.lit(False))

    def told(name: str, clean) -> Column:
        value = F.col(f"last.f_{name}")
        empty = value.isNull() | squashed(value).isin(*NO_VALUE)
        return F.when(snapshot | value.isNotNull(), F.struct(F.when(~empty, clean(value)).alias("v"))).alias(name)

    return rows.select(*entity, "at", *(told(n, f) for n, f in fields.items()))


def _sliced(rows: DataFrame, entity: Sequence[str], slice_rows: int) -> DataFrame:
    """rows with ``sliced`` and ``slice``: 0 for entities of at most slice_rows rows, else the number of a run of hours holding about slice_rows rows."""
    hour = F.date_trunc("hour", F.col("at"))
    hours = rows.groupBy(*entity, hour.alias("hour")).agg(F.count("*").alias("n"))
    size = hours.groupBy(*entity).agg(F.sum("n").alias("total")).where(F.col("total") > slice_rows).select(*entity)
    run = Window.partitionBy(*entity).orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    # An entity has at most one row an hour here, however many changes it has.
    cuts = hours.join(size, list(entity), "left_semi").select(*entity, "hour", F.floor((F.sum("n").over(run) - F.col("n")) / slice_rows).cast("int").alias("slice"))
    rows = rows.withColumn("hour", hour).join(cuts, [*entity, "hour"], "left").withColumn("sliced", F.col("slice").isNotNull())
    return rows.withColumn("slice", F.coalesce("slice", F.lit(0))).drop("hour")


def build_history(rows: DataFrame, entity: Sequence[str] = ("doc_id", "ref_key"), fields: Sequence[str] = tuple(FIELDS), slice_rows: int = 50_000) -> DataFrame:
    """All versions of all entities: the entity, the fields, valid_from, valid_to (null: still valid), version (from 1) and is_current.

    ``rows`` comes from ``changes``. An empty table gives an empty history; a field that no change has told yet has no value. A version begins with the
    first change and with each change after which any field differs.
    """
    entity, fields = list(entity), list(fields)
    rows = cut(_sliced(rows, entity, slice_rows))
    within = Window.partitionBy(*entity, "slice").orderBy("at")
    filled = rows.select(*entity, "slice", "at", *[F.last(n, ignorenulls=True).over(within).alias(n) for n in fields])

    # What each slice takes over from the slices before: one row a slice, scanned in order. Only sliced entities have such rows.
    ends = rows.groupBy(*entity, "slice").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("at"))).alias(n) for n in fields], F.max("sliced").alias("sliced")).where("sliced")
    before = Window.partitionBy(*entity).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    taken = ends.select(*entity, "slice", F.struct(*[F.last(n, ignorenulls=True).over(before)["v"].alias(n) for n in fields]).alias("taken")).where("slice > 0")
    state = filled.join(taken, [*entity, "slice"], "left")
    state = state.select(*entity, "slice", "at", "taken", F.struct(*[F.when(F.col(n).isNotNull(), F.col(n)["v"]).otherwise(F.col("taken")[n]).alias(n) for n in fields]).alias("state"))
    # A row is compared with the row before, the first one of a slice with what the slice takes over.
    state = state.withColumn("before", F.coalesce(F.lag("state").over(within), "taken"))
    starts = cut(state.where(F.col("before").isNull() | ~F.col("state").eqNullSafe(F.col("before"))).select(*entity, "slice", "at", "state"))

    order = Window.partitionBy(*entity).orderBy("slice")
    links = starts.groupBy(*entity, "slice").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    links = links.select(*entity, "slice", (F.sum("n").over(order) - F.col("n")).alias("earlier"), F.lead("first_at").over(order).alias("later_at"))
    number = F.row_number().over(within) + F.col("earlier")
    valid_to = F.coalesce(F.lead("at").over(within), "later_at")
    return starts.join(links, [*entity, "slice"]).select(*entity, number.cast("int").alias("version"), *[F.col(f"state.{n}").alias(n) for n in fields], F.col("at").alias("valid_from"), valid_to.alias("valid_to"), valid_to.isNull().alias("is_current"))


def rebuild_affected(history: DataFrame, raw_changes: DataFrame, batch: DataFrame, entity: Sequence[str] = ("doc_id", "ref_key"), **options) -> DataFrame:
    """The history after a batch of late or corrected changes.

    ``raw_changes`` holds all raw changes, those of the batch among them. The entities of the batch are touched: their raw changes are read, all their
    intervals built anew, and their old chains dropped; all other chains are taken over as they are. An empty batch gives the history unchanged.
    """
    entity = list(entity)
    touched = batch.select(*entity).distinct()
    anew = build_history(raw_changes.join(touched, entity, "left_semi"), entity, **options)
    return history.join(touched, entity, "left_anti").unionByName(anew)


def history_as_of(history: DataFrame, moment: Column) -> DataFrame:
    """The version of each entity that was valid at a moment."""
    return history.where((F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment)))


def _entity_bucket(entity: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*entity), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _write_buckets(rows: DataFrame, to: str, mode: str = "errorifexists") -> None:
    """rows by their ``_bucket``, few files for a small bucket and several for a large one."""
    rows.hint("rebalance", "_bucket").write.mode(mode).partitionBy("_bucket").parquet(to)


@dataclass
class ChangeLog:
    """Raw changes in files, in ``buckets`` folders by hash of the entity, so that the changes of a few entities are read without the others."""

    spark: SparkSession
    path: str
    entity: Sequence[str] = ("doc_id", "ref_key")
    buckets: int = 64
    schema: T.StructType | None = None

    def append(self, raw: DataFrame) -> None:
        """Add raw changes. Rows without an entity belong to no chain and are left out."""
        for key in self.entity:
            raw = raw.where(F.col(key).isNotNull())
        self.schema = raw.schema
        _write_buckets(raw.withColumn("_bucket", _entity_bucket(self.entity, self.buckets)), self.path, "append")

    def of(self, touched: DataFrame) -> DataFrame:
        """All raw changes of the touched entities; only their buckets are read."""
        hit = [r[0] for r in touched.select(_entity_bucket(self.entity, self.buckets).alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        reader = self.spark.read.schema(T.StructType([*self.schema, T.StructField("_bucket", T.IntegerType())])) if self.schema else self.spark.read
        rows = reader.parquet(self.path).where(F.col("_bucket").isin(hit)).drop("_bucket")
        return rows.join(touched.select(*self.entity).distinct(), list(self.entity), "left_semi")


@dataclass
class ChainStore:
    """Histories in files, in ``buckets`` folders by hash of the entity.

    A commit writes the buckets that hold touched chains under a new number and then one small list that names the number of each bucket. Readers take the last
    complete list, so they see either all old chains or all new ones; a job that dies before its list is complete changes nothing. A bucket without any chain
    left stands in no list. A store keeps the number of buckets that it was made with.
    """

    spark: SparkSession
    path: str
    entity: Sequence[str] = ("doc_id", "ref_key")
    buckets: int = 64

    def _numbers(self) -> list[int]:
        """Numbers of all complete commits."""
        fs, path = _files(self.spark, self.path)
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[6:]) for n in names if n.startswith("names-") and fs.exists(_files(self.spark, f"{self.path}/{n}/_SUCCESS")[1]))

    def current(self) -> dict[int, int]:
        """The number under which each bucket was last written."""
        done = self._numbers()
        rows = self.spark.read.schema("bucket int, number int, buckets int").json(f"{self.path}/names-{done[-1]}").collect() if done else []
        if rows:
            self.buckets = rows[0].buckets
        return {r.bucket: r.number for r in rows if r.bucket is not None}

    def _next(self) -> int:
        """A number that no folder has, not even one left by a commit that died."""
        fs, path = _files(self.spark, f"{self.path}/chains")
        used = [int(x.getPath().getName()[7:]) for x in fs.listStatus(path)] if fs.exists(path) else []
        return max(used, default=0) + 1

    def _read(self, now: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/chains/number={n}/_bucket={b}" for b, n in sorted(now.items())]
        return self.spark.read.option("basePath", f"{self.path}/chains").parquet(*paths).drop("number", "_bucket") if paths else None

    def read(self) -> DataFrame | None:
        """All chains, None where there are none."""
        return self._read(self.current())

    def commit(self, chains: DataFrame, touched: DataFrame | None = None) -> None:
        """Put ``chains`` in place of the chains of the touched entities (None: of all entities). A touched entity without new chains loses its old ones."""
        now, number, rows = self.current(), self._next(), chains
        if touched is None:
            now = {}
        elif now:
            hit = [r[0] for r in touched.select(_entity_bucket(self.entity, self.buckets).alias("b")).distinct().collect()]  # at most ``buckets`` numbers
            old = self._read({b: now[b] for b in hit if b in now})
            if old is not None:
                rows = rows.unionByName(old.join(touched.select(*self.entity).distinct(), list(self.entity), "left_anti"))
            now = {b: n for b, n in now.items() if b not in hit}
        to = f"{self.path}/chains/number={number}"
        _write_buckets(rows.withColumn("_bucket", _entity_bucket(self.entity, self.buckets)), to)
        fs, folder = _files(self.spark, to)
        written = [int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(folder) if "=" in x.getPath().getName()]
        names = [(b, n, self.buckets) for b, n in sorted((now | dict.fromkeys(written, number)).items())] or [(None, number, self.buckets)]
        self.spark.createDataFrame(names, "bucket int, number int, buckets int").coalesce(1).write.json(f"{self.path}/names-{number}")


def replayed_history(raw: DataFrame, late_days: int = 90, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """The history of a table of raw changes, made as in daily work: chains from what had arrived ``late_days`` before the last arrival, then one rebuild of
    the chains touched by everything that came after.

    Raw changes and chains are kept in a folder (a new one in the shared folder, if none is given), in as many buckets as the session has shuffle
    partitions. Of the raw changes only those of touched entities are read again, and their chains are replaced in one commit.
    """
    spark = raw.sparkSession
    last = raw.agg(F.max("arrived_at")).first()[0]
    if last is None:
        return build_history(changes(raw))
    path = path or f"{shared_dir(spark)}/history-{uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    log, store = ChangeLog(spark, f"{path}/raw", buckets=buckets), ChainStore(spark, f"{path}/store", buckets=buckets)
    in_time = F.coalesce(F.col("arrived_at") <= F.lit(last) - F.expr(f"interval {int(late_days)} days"), F.lit(True))
    early, late = raw.where(in_time), raw.where(~in_time)
    log.append(early)
    store.commit(build_history(changes(early)))
    log.append(late)
    touched = cut(late.select("doc_id", "ref_key").where("doc_id IS NOT NULL AND ref_key IS NOT NULL").distinct())
    store.commit(build_history(changes(log.of(touched))), touched)
    chains = store.read()
    return build_history(changes(raw.limit(0))) if chains is None else chains
