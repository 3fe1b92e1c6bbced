"""Long exact spans shared between records, found with a log-structured index of window fingerprints.

Every text is cut down to a few fingerprints: of each ``w`` consecutive windows of ``k`` characters those with the smallest hash are kept (winnowing), so two
texts that share ``k + w - 1`` characters share a fingerprint there. The index is a list of immutable runs, each sorted by hash; a new batch is merge-joined
with every run and with itself, its matches are verified character by character, and it becomes a run. ``compact`` merges runs of like size into one. A list of
the runs is kept beside them, so that ``SpanIndex.opened`` finds the index again in another session.

A shared span of the full length reaches at least half of its rest beyond the fingerprint on one side. So each fingerprint carries two short hashes of itself
with that much of its surroundings, before and behind; occurrences that agree in neither are no candidates. What is left is reduced to one row for each two
texts and distance between their places, and only then a part of one text is sent to the other and compared.

Texts are stored once, however many records hold them. A fingerprint that occurs very often (a formula in a third of all records, or a text that repeats
itself) is not paired: its surroundings are hashed at every offset in the full span length, and the result tells who holds which span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.session import kept, shared_dir

#: Fixed values of the rolling hash: an odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
#: Characters handled at a time, pairs made at a time, texts that a task remembers to have sent.
BLOCK, PAIRS, SENT = 1 << 18, 1 << 20, 1 << 18


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each window of k code points."""
    n = len(codes)
    room = 1 << max(1, n - 1).bit_length()
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * _powers(BASE, room)[:n], dtype=np.uint64, out=sums[1:])
    h = (sums[k:] - sums[:-k]) * _powers(INVERSE, room)[: n - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sliding(values: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """best (minimum or maximum) of each w consecutive values, in two passes over blocks of w."""
    n = len(values)
    end = np.uint64(2**64 - 1) if best is np.minimum else np.uint64(0)
    blocks = np.concatenate([values, np.full(-n % w, end, np.uint64)]).reshape(-1, w)
    ahead = best.accumulate(blocks, axis=1).ravel()
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - w + 1], ahead[w - 1 : n])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _packed(texts: list[str], span: int, margin: int) -> Iterator[list[tuple[int, int, int, int, str]]]:
    """Texts in packs of about BLOCK characters: (number of the text, place of the piece in it, first and last but one span start in the piece, piece). A long
    text comes in pieces that share margins, so that each of its spans starts in exactly one piece and is seen with its surroundings."""
    pack, size = [], 0
    for i, text in enumerate(texts):
        n = len(text) - span + 1
        for start in range(0, n, BLOCK):
            lo, count = max(0, start - margin), min(BLOCK, n - start)
            piece = text[lo : start + count + span - 1 + margin]
            pack.append((i, lo, start - lo, start - lo + count, piece))
            size += len(piece)
            if size >= BLOCK:
                yield pack
                pack, size = [], 0
    if pack:
        yield pack


def selected(texts: list[str], k: int, w: int) -> tuple[np.ndarray, ...]:
    """(number of the text, place, hash, hashes of the surroundings) of the kept windows of texts of at least k + w - 1 characters.

    The last is two numbers of 16 bits, 0 where the text ends too soon: the window with ``reach`` characters before it, and with as many behind it.
    """
    reach, out = w // 2, []
    for pack in _packed(texts, k + w - 1, reach):
        codes = _codes("".join(piece for *_, piece in pack))
        number, lo, first, last = np.array([x[:4] for x in pack], np.int64).T
        sizes = np.array([len(x[4]) for x in pack])
        begin = np.cumsum(sizes) - sizes
        h = window_hashes(codes, k)
        # Only runs of w windows that lie in one piece, and start where it says, count.
        edge = np.zeros(len(h) - w + 2, np.int8)
        edge[begin + first] += 1
        edge[begin + last] -= 1
        least = np.where(np.cumsum(edge[:-1]) > 0, sliding(h, w, np.minimum), np.uint64(0))
        none = np.zeros(w - 1, np.uint64)
        (at,) = np.nonzero(sliding(np.concatenate([none, least, none]), w, np.maximum) == h)
        piece = np.searchsorted(begin, at, "right") - 1
        wide = (window_hashes(codes, k + reach) & np.uint64(0xFFFF)).astype(np.int64)
        before, behind = at - reach >= begin[piece], at + k + reach <= (begin + sizes)[piece]
        ext = np.where(before, np.maximum(wide[np.maximum(at - reach, 0)], 1), 0) << 16 | np.where(behind, np.maximum(wide[np.minimum(at, len(wide) - 1)], 1), 0)
        out.append((number[piece], at - begin[piece] + lo[piece], h[at].view(np.int64), ext))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    number, place, h, ext = (np.concatenate(x) for x in zip(*out))
    # Pieces of one long text may keep the same window.
    _, once = np.unique(np.stack([number, place]), axis=1, return_index=True) if max(map(len, texts)) > BLOCK else (None, slice(None))
    return number[once], place[once], h[once], ext[once]


def fingerprints(texts: DataFrame, k: int, w: int) -> DataFrame:
    """(h, t, pos, ext) for each kept window of texts (t, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, place, h, ext = selected(batch.column(1).to_pylist(), k, w)
            columns = [pa.array(h), batch.column(0).take(pa.array(number)), pa.array(place.astype(np.int32)), pa.array(ext.astype(np.uint32).view(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["h", "t", "pos", "ext"])

    return texts.select("t", "text").where(F.length("text") >= k + w - 1).mapInArrow(run, "h long, t long, pos int, ext int")


def _told_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, tid, text) without those that a task has sent before, so that a text of which there are many copies leaves each task once."""
    sent: set[bytes] = set()
    for batch in batches:
        keep = []
        for tid in batch.column(1).to_pylist():
            keep.append(tid not in sent)
            sent.add(tid)
        if len(sent) > SENT:
            sent.clear()
        yield batch.filter(pa.array(keep, pa.bool_()))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of the occurrences of one fingerprint to pairs of places in different texts that may share a span; occurrences of frequent ones to pairs of a
    place with itself."""
    names = ["t_a", "pos_a", "t_b", "pos_b"]
    for batch in batches:
        often, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        start = lists.offsets.to_numpy()
        size, t, pos, ext, new = np.diff(start), *(lists.values.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        own = np.repeat(often, size)[: len(t)]
        where = np.arange(start[0], start[-1])[own]
        yield pa.RecordBatch.from_arrays([pa.array(x[where]) for x in (t, pos, t, pos)], names)
        for m in np.unique(size[~often & (size > 1)]):
            of, (i, j) = start[:-1][~often & (size == m)], np.triu_indices(m, 1)
            step = max(1, PAIRS // len(i))
            for some in range(0, len(of), step):
                a, b = ((of[some : some + step, None] + x).ravel() for x in (i, j))
                both = ext[a] ^ ext[b]
                near = (both >> 16 == 0) & (ext[a] >> 16 != 0) | (both & 0xFFFF == 0) & (ext[a] & 0xFFFF != 0)
                ok = near & (t[a] != t[b]) & (new[a] | new[b])
                a, b = a[ok], b[ok]
                a, b = np.where(t[a] < t[b], a, b), np.where(t[a] < t[b], b, a)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t[a], pos[a], t[b], pos[b])], names)


def _verified(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (tid_a, at_a, tid_b, at_b, a, b), two parts of texts from two places on, to the longest runs of at least ``span`` equal characters in them."""
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
            for begin, end in _ranges([min(len(x), len(y)) for x, y in zip(a, b)]):
                sizes = np.array([min(len(x), len(y)) + 1 for x, y in zip(a[begin:end], b[begin:end])])
                first = np.cumsum(sizes) - sizes
                # A character after each part that differs from that after its partner ends every run.
                equal = _codes("".join(x[: n - 1] + "\0" for x, n in zip(a[begin:end], sizes))) == _codes("".join(x[: n - 1] + "\1" for x, n in zip(b[begin:end], sizes)))
                change = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
                lo, hi = change[::2], change[1::2]
                lo, hi = lo[hi - lo >= span], hi[hi - lo >= span]
                row = np.searchsorted(first, lo, "right") - 1
                rows = batch.slice(begin, end - begin).take(pa.array(row))
                at = [rows.column(f"at_{x}").to_numpy() - first[row] for x in "ab"]
                columns = [rows.column("tid_a"), pa.array((at[0] + lo).astype(np.int32)), pa.array((at[0] + hi).astype(np.int32))]
                columns += [rows.column("tid_b"), pa.array((at[1] + lo).astype(np.int32)), pa.array((at[1] + hi).astype(np.int32)), pa.nulls(len(row), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, MATCH)

    return run


def _ranges(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BLOCK characters together."""
    begin = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= BLOCK or i == len(sizes) - 1:
            yield begin, i + 1
            begin, total = i + 1, 0


def _spans_around(span: int, k: int):
    side = span - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(tid, places, text) to the start and a hash of each span of full length that holds one of the places."""
        for batch in batches:
            owner, starts, hashes = [], [], []
            for i, (places, text) in enumerate(zip(batch.column("places").to_pylist(), batch.column("text").to_pylist())):
                last = len(text) - span
                edge = np.zeros(last + 2, np.int32)
                p = np.array(places)
                np.add.at(edge, np.clip(p - side, 0, last + 1), 1)
                np.add.at(edge, np.clip(p + 1, 0, last + 1), -1)
                (at,) = np.nonzero(np.cumsum(edge)[:-1] > 0)
                codes = _codes(text)
                for block in np.split(at, np.flatnonzero(np.diff(at // BLOCK)) + 1):
                    if len(block):
                        hashes.append(window_hashes(codes[block[0] : block[-1] + span], span)[block - block[0]])
                starts.append(at)
                owner.append(np.full(len(at), i))
            if owner:
                yield pa.RecordBatch.from_arrays([batch.column("tid").take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(hashes).view(np.int64) if hashes else np.zeros(0, np.int64))], ["tid", "start", "g"])

    return run


MATCH = ["tid_a", "start_a", "end_a", "tid_b", "start_b", "end_b", "g"]
_MATCH = "tid_a binary, start_a int, end_a int, tid_b binary, start_b int, end_b int, g long"
RUN_COLUMNS, TEXT_COLUMNS = "h BIGINT, t BIGINT, pos INT, ext INT", "t BIGINT, tid BINARY, text STRING"


@dataclass
class SpanIndex:
    """The index: runs of fingerprints, and the texts behind them, in a shared folder.

    ``span`` is the least length that counts. ``hot``: a fingerprint with more occurrences is matched by whole spans. ``fan``: runs of one level that are
    merged into one of the next. ``buckets``: files of each table; 0: as many as the session has shuffle partitions. Only distinct texts are indexed; ``add`` takes (tid, text) with tid = text_id(text). Inside the index a text is known by
    a hash of 64 bits of its id; two texts that agree in it are both stored, and both compared.
    """

    spark: SparkSession
    span: int = 120
    k: int = 50
    buckets: int = 0
    hot: int = 64
    fan: int = 4
    path: str = ""
    runs: list[tuple[int, str, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.path = self.path or f"{shared_dir(self.spark)}/spans-{uuid4().hex}"
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.w = self.span - self.k + 1

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> SpanIndex:
        """The index of a folder as its last complete list of runs tells it, in any session."""
        fs, folder = _files(spark, path)
        lists = sorted(int(n[5:]) for n in (x.getPath().getName() for x in fs.listStatus(folder)) if n.startswith("list-") and fs.exists(_files(spark, f"{path}/{n}/_SUCCESS")[1]))
        rows = spark.read.schema("span int, k int, buckets int, hot int, fan int, level int, run string, texts string").json(f"{path}/list-{lists[-1]}").collect()  # as many rows as runs
        index = cls(spark, rows[0].span, rows[0].k, rows[0].buckets, rows[0].hot, rows[0].fan, path, [(r.level, r.run, r.texts) for r in rows])
        for _, run, texts in index.runs:
            for name, columns, key in ((run, RUN_COLUMNS, "h"), (texts, TEXT_COLUMNS, "t")):
                spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {index.buckets} BUCKETS LOCATION '{path}/{name}'")
        return index

    def _save(self) -> None:
        fs, folder = _files(self.spark, self.path)
        last = max((int(x.getPath().getName()[5:]) for x in fs.listStatus(folder) if x.getPath().getName().startswith("list-")), default=0)
        rows = [(self.span, self.k, self.buckets, self.hot, self.fan, *r) for r in self.runs]
        self.spark.createDataFrame(rows, "span int, k int, buckets int, hot int, fan int, level int, run string, texts string").coalesce(1).write.json(f"{self.path}/list-{last + 1}")

    def _write(self, df: DataFrame, key: str) -> str:
        """An immutable table in ``buckets`` files by ``key``, each sorted, so that a later merge join does not shuffle it. df comes partitioned so."""
        name = f"spans_{uuid4().hex}"
        options = {"path": f"{self.path}/{name}", "compression": "zstd", "parquet.enable.dictionary#h": "false"}
        df.write.bucketBy(self.buckets, key).sortBy(key).options(**options).format("parquet").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        fs, folder = _files(self.spark, f"{self.path}/{name}")
        fs.delete(folder, True)

    def add(self, batch: DataFrame) -> DataFrame:
        """Index the texts of a batch that are new, and return what the new texts share with all, kept in files: verified matches (tid_a, start_a, end_a,
        tid_b, start_b, end_b), each a longest run of equal characters, and for spans of frequent fingerprints rows without a partner, which have the same
        ``g`` where they hold the same span."""
        texts = batch.where(F.length("text") >= self.span).select(F.xxhash64("tid").alias("t"), "tid", "text").mapInArrow(_told_once, "t long, tid binary, text string")
        texts = texts.repartition(self.buckets, "t").dropDuplicates(["t", "tid"])
        for _, _, old in self.runs:
            known = self.spark.table(old).select("t", F.col("tid").alias("known"))
            texts = texts.join(known.hint("merge"), "t", "left").where("known IS NULL OR known != tid").drop("known")
        text_table = self._write(texts, "t")
        run = self._write(fingerprints(self.spark.table(text_table), self.k, self.w).repartition(self.buckets, "h"), "h")
        self.runs.append((0, run, text_table))
        self._save()
        return self._matches(run)

    def compact(self) -> None:
        """Merge the runs of each level that has ``fan`` of them into one run of the next level; the files of the merged ones go once the new list is complete."""
        level, gone = 0, []
        while any(n >= level for n, _, _ in self.runs):
            same = [r for r in self.runs if r[0] == level]
            if len(same) >= self.fan:
                merged = []
                for i, key in ((1, "h"), (2, "t")):
                    whole = self.spark.table(same[0][i])
                    for r in same[1:]:
                        whole = whole.unionByName(self.spark.table(r[i]))
                    merged.append(self._write(whole.repartition(self.buckets, key), key))
                self.runs = [r for r in self.runs if r[0] != level] + [(level + 1, *merged)]
                gone += [name for r in same for name in r[1:]]
            level += 1
        if gone:
            self._save()
            for name in gone:
                self._drop(name)

    def _with_texts(self, rows: DataFrame, key: str) -> DataFrame:
        """rows, partitioned by ``key`` as the tables are, with (tid, text) of the texts known by it. Each run's texts are joined by themselves, as a union of
        bucketed tables would be shuffled."""
        out = None
        for _, _, name in self.runs:
            met = rows.join(self.spark.table(name).withColumnRenamed("t", key).hint("merge"), key)
            out = met if out is None else out.unionByName(met)
        return out

    def _matches(self, new: str) -> DataFrame:
        """Merge-join the new run with itself and with each old run, and verify what meets."""
        fresh = self.spark.table(new)
        rows = fresh.withColumn("new", F.lit(True))
        for _, run, _ in self.runs:
            if run != new:
                met = self.spark.table(run).join(fresh.select("h").distinct().hint("merge"), "h", "left_semi")
                rows = rows.unionByName(met.withColumn("new", F.lit(False)))
        same = Window.partitionBy("h")
        spots = rows.select("*", F.count("*").over(same).alias("n"), F.min("t").over(same).alias("lo"), F.max("t").over(same).alias("hi")).where("lo != hi")
        # The occurrences of a frequent fingerprint are cut into lists of about the same length as the others have.
        part = F.when(F.col("n") > self.hot, F.pmod(F.xxhash64("t", "pos"), F.ceil(F.col("n") / self.hot)))
        lists = spots.groupBy("h", (F.col("n") > self.hot).alias("often"), part.alias("part")).agg(F.collect_list(F.struct("t", "pos", "ext", "new")).alias("spots"))
        places = lists.select("often", "spots").mapInArrow(_candidates, "t_a long, pos_a int, t_b long, pos_b int")
        # One row for each two texts and distance of places, however many fingerprints they share there. A frequent one's place stands as a pair with itself.
        apart = F.when(F.col("t_a") == F.col("t_b"), F.col("pos_a")).otherwise(F.col("pos_a") - F.col("pos_b"))
        pairs = places.repartition(self.buckets, "t_b").groupBy("t_b", "t_a", apart.alias("apart")).agg(F.min("pos_a").alias("lo"), F.max("pos_a").alias("hi"))
        table = self._write(pairs, "t_b")
        pairs = self.spark.table(table)
        found = self._compared(pairs.where("t_a != t_b"))
        often = pairs.where("t_a = t_b")
        if not often.isEmpty():
            found = found.unionByName(self._by_whole_spans(often.select(F.col("t_b").alias("t"), F.col("lo").alias("pos"))))
        found = kept(found)
        self._drop(table)
        return found

    def _compared(self, pairs: DataFrame) -> DataFrame:
        """Longest runs of equal characters of pairs of texts (t_a, t_b, apart, lo, hi), around the fingerprints that they share from ``lo`` to ``hi``: a span
        of full length that holds one of these cannot begin or end farther away than its rest."""
        side = self.w - 1
        ahead = F.least(F.col("lo"), F.col("lo") - F.col("apart"), F.lit(side))
        pairs = pairs.select("t_a", "t_b", (F.col("lo") - ahead).alias("at_a"), (F.col("lo") - F.col("apart") - ahead).alias("at_b"), (ahead + F.col("hi") - F.col("lo") + self.k + side).alias("size"))
        for x in "ba":
            pairs = self._with_texts(pairs if x == "b" else pairs.repartition(self.buckets, "t_a"), f"t_{x}").withColumnRenamed("tid", f"tid_{x}")
            pairs = pairs.withColumn(x, F.substring("text", F.col(f"at_{x}") + 1, F.col("size"))).drop("text", f"t_{x}")
        return pairs.select("tid_a", "at_a", "tid_b", "at_b", "a", "b").mapInArrow(_verified(self.span), _MATCH)

    def _by_whole_spans(self, places: DataFrame) -> DataFrame:
        """Every place (tid_a, start_a, end_a, g) of every span around places (t, pos) of frequent fingerprints that more than one text holds."""
        texts = self._with_texts(places.repartition(self.buckets, "t").groupBy("t").agg(F.collect_list("pos").alias("places")), "t")
        every = kept(texts.select("tid", "places", "text").mapInArrow(_spans_around(self.span, self.k), "tid binary, start int, g long"))
        shared = every.groupBy("g").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi")).where("lo != hi").select("g")
        none = [F.lit(None).cast(t).alias(n) for n, t in (("tid_b", "binary"), ("start_b", "int"), ("end_b", "int"))]
        return every.join(shared, "g", "left_semi").select(F.col("tid").alias("tid_a"), F.col("start").alias("start_a"), (F.col("start") + self.span).alias("end_a"), *none, "g")


def _files(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def text_id(text: Column) -> Column:
    return F.unhex(F.md5(text))


def parts_of(records: DataFrame, key: str, fields: list[str], span: int = 120) -> DataFrame:
    """(rec, field, tid, text) for each field of each record that is long enough to share a span; nulls and shorter texts are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("p")
    rows = records.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("rec"), each).select("rec", "p.field", "p.text").where(F.length("text") >= span)
    return rows.withColumn("tid", text_id(F.col("text")))


def shared_matches(batches: list[DataFrame], spark: SparkSession, span: int = 120, **options) -> tuple[DataFrame, DataFrame]:
    """Add the batches (of ``parts_of``) to a new index one after the other.

    Returns the matches between different texts, and the members (rec, field, tid) of all texts. Records with the same text are members of one text and are not
    listed as matches. Rows without a second text only tell a part of a text that frequent spans cover; those with the same ``g`` hold the same span.
    """
    index = SpanIndex(spark, span, **options)
    matches = None
    members = None
    for batch in batches:
        found = index.add(batch.select("tid", "text"))
        index.compact()
        matches = found if matches is None else matches.unionByName(found)
        own = batch.select("rec", "field", "tid")
        members = own if members is None else members.unionByName(own)
    return matches, kept(members.distinct())


def record_pairs(matches: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of records (rec_a < rec_b) that share a span in any of their fields, copies of one text among them.

    Who holds the same text, or the same span of a frequent fingerprint, is a group; as all pairs are asked for, groups are paired here, and only here.
    """
    held = members.select("rec", "tid")
    a, b = (held.select(F.col("rec").alias(f"r_{x}"), F.col("tid").alias(f"tid_{x}")) for x in "ab")
    different = matches.where("tid_b IS NOT NULL").select("tid_a", "tid_b").distinct().join(a, "tid_a").join(b, "tid_b").select("r_a", "r_b").where("r_a != r_b")
    spans = matches.where("tid_b IS NULL").select("g", F.col("tid_a").alias("tid")).distinct()
    # Neighbouring spans of one long passage have the same holders; one of them stands for all.
    alike = spans.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.xxhash64("tid").cast("decimal(20,0)")).alias("sum"), F.min("tid").alias("lo"), F.max("tid").alias("hi"))
    one = alike.groupBy("n", "sum", "lo", "hi").agg(F.min("g").alias("g")).select("g")
    several = held.groupBy("tid").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi")).where("lo != hi").select("tid")
    pairs = different
    for groups, by in ((spans.join(one, "g", "left_semi").join(held, "tid").select("g", "rec").distinct(), "g"), (held.join(several, "tid", "left_semi"), "tid")):
        pairs = pairs.unionByName(groups.select(by, F.col("rec").alias("r_a")).join(groups.select(by, F.col("rec").alias("r_b")), by).where("r_a < r_b").select("r_a", "r_b"))
    return pairs.select(F.least("r_a", "r_b").alias("rec_a"), F.greatest("r_a", "r_b").alias("rec_b")).distinct()


def shared_passages(matches: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """(rec, field, tid, n_chars, start, end): the separate passages of each field that other records hold too.

    ``texts`` is (rec, field, tid, text). What a record holds only in its own other fields is not shared. A text that another record holds as a whole is one
    passage. Each span carries the least and greatest record that holds it elsewhere, which tells whether there is another record than the text's own.
    """
    held = members.groupBy("tid").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi"))
    direct, often = matches.where("tid_b IS NOT NULL"), matches.where("tid_b IS NULL").select("g", F.col("tid_a").alias("tid"), F.col("start_a").alias("s"), F.col("end_a").alias("e")).distinct()
    spans = None
    for x, y in ("ab", "ba"):
        one = direct.select(F.col(f"tid_{x}").alias("own"), F.col(f"start_{x}").alias("s"), F.col(f"end_{x}").alias("e"), F.col(f"tid_{y}").alias("tid"))
        one = one.join(held, "tid").select(F.col("own").alias("tid"), "s", "e", "lo", "hi")
        spans = one if spans is None else spans.unionByName(one)
    holders = often.select("g", "tid").distinct().join(held, "tid").groupBy("g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spans = spans.unionByName(often.join(holders, "g").select("tid", "s", "e", "lo", "hi")).groupBy("tid", "s", "e").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # Only the texts of one record are covered in part: those of several are covered wholly.
    alone = held.where("lo = hi").select("tid", F.col("lo").alias("rec"))
    spans = spans.join(alone, "tid").where("lo != rec OR hi != rec").select("tid", "s", "e")
    # The spans of one text, at most one for each pair of its positions, merged in order.
    order = Window.partitionBy("tid").orderBy("s", "e")
    spans = spans.withColumn("reach", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = (F.col("reach").isNull() | (F.col("s") > F.col("reach"))).cast("int")
    spans = spans.withColumn("passage", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = spans.groupBy("tid", "passage").agg(F.min("s").alias("start"), F.max("e").alias("end")).select("tid", "start", "end")
    rows = texts.select("rec", "field", "tid", F.length("text").alias("n_chars")).distinct()
    whole = rows.join(held.where("lo != hi").select("tid"), "tid", "left_semi").select("rec", "field", "tid", "n_chars", F.lit(0).alias("start"), F.col("n_chars").alias("end"))
    return rows.join(parts, "tid").select("rec", "field", "tid", "n_chars", "start", "end").unionByName(whole)


def shared_cover(matches: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """For each field of each record: its length, how many of its characters other records hold too, and the number of separate shared passages.

    ``texts`` is (rec, field, tid, text). A text that another record holds as a whole is covered wholly.
    """
    none = texts.select("rec", "field", "tid", F.length("text").alias("n_chars"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")).distinct()
    rows = shared_passages(matches, members, texts).unionByName(none)
    size = F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("int")
    return rows.groupBy("rec", "field", "tid", "n_chars").agg(size.alias("shared_chars"), F.count("start").cast("int").alias("passages")).drop("tid")
