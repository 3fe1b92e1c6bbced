"""Near-duplicate records: BK-trees over bit signatures, in bounded shards that are broadcast to the records that may match them.

The similarity is intersection / union of the sets of 5-character substrings of the normalised texts. Each set gets ``bits`` one-bit minima of seeded hashes:
two sets of similarity s differ in about (1 - s) / 2 of the bits, so records of similarity 0.8 lie within an integer Hamming radius (the mean and 4.5
standard deviations). A BK-tree holds signatures with children keyed by their distance to the parent; a search follows only edges within the radius.

One tree over everything would visit nearly all nodes at that radius, so records are first sent to shards: those that agree in a band of whole minima share
a bucket (two records of similarity 0.8 miss all buckets with probability ``miss_rate``), and a bucket is cut into blocks of at most ``block`` records. Each
tree of a block is searched with the records of its own and of every later block. Candidates within the radius are verified by the exact similarity.
Texts that are equal after normalisation are one text throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.history import squashed
from attesta.session import cut, kept

#: Minima taken of each set, in bands of so many rows.
BANDS, ROWS = 32, 6
SHINGLE = 5
_rng = np.random.default_rng(20240901)
_MULT = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def miss_rate(similarity: float) -> float:
    """Probability that two records of a similarity share no bucket."""
    return (1 - similarity**ROWS) ** BANDS


def radius(threshold: float, bits: int = BANDS * ROWS) -> int:
    p = (1 - threshold) / 2
    return math.ceil(bits * p + 4.5 * math.sqrt(bits * p * (1 - p)))


def normalised(text: Column) -> Column:
    return squashed(F.lower(text))


def shingles(text: str) -> np.ndarray:
    """Sorted 64-bit values of the distinct substrings of SHINGLE characters; a shorter text is its own only substring."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < SHINGLE:
        codes = np.concatenate([codes, np.full(SHINGLE - len(codes), 0x110000, np.uint64)])
    n = len(codes) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        h = h * np.uint64(0x100000001B3) + codes[i : i + n] + np.uint64(1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
    return np.unique(h)


def minima(values: np.ndarray) -> np.ndarray:
    """The minimum of each seeded hash over a set, in blocks so that a very long text needs little memory."""
    out = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 1024):
        h = _MULT[:, None] * short[i : i + 1024] + _ADD[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return out


def signature(least: np.ndarray) -> bytes:
    """One bit of each minimum. The bit comes from a mixed value, as the low bits of small minima are not even."""
    mixed = least * np.uint32(0x85EBCA6B)
    return np.packbits(((mixed ^ (mixed >> np.uint32(15))) >> np.uint32(7)).astype(np.uint8) & 1).tobytes()


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for tid, text in zip(pdf["tid"], pdf["text"]):
            least = minima(own := shingles(text))
            bands = least.reshape(BANDS, ROWS).astype(np.uint64)
            key = np.arange(1, BANDS + 1, dtype=np.uint64)
            for i in range(ROWS):
                key = (key ^ bands[:, i]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
            rows.append((tid, signature(least), len(own), key.view(np.int64)))
        yield pd.DataFrame(rows, columns=["tid", "sig", "size", "buckets"])


class BKTree:
    """Signatures as Python integers; children keyed by the distance to their parent."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, sig: int, item: int) -> None:
        if self.root is None:
            self.root = [sig, [item], {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ sig).bit_count()
            if d == 0:
                node[1].append(item)
                return
            nxt = node[2].get(d)
            if nxt is None:
                node[2][d] = [sig, [item], {}]
                return
            node = nxt

    def search(self, sig: int, within: int) -> Iterator[int]:
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            d = (node[0] ^ sig).bit_count()
            if d <= within:
                yield from node[1]
            stack += [child for edge, child in node[2].items() if d - within <= edge <= d + within]


def _search(within: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket, tree and role: the records of a tree, each looked up among the earlier ones and then added, and after them the records
        of later blocks, which are only looked up. One tree is held at a time."""
        shard, tree, held = None, BKTree(), []
        for pdf in batches:
            out = set()
            for bucket, number, role, tid, sig, size in zip(pdf["bucket"], pdf["tree"], pdf["role"], pdf["tid"], pdf["sig"], pdf["size"]):
                if shard != (bucket, number):
                    shard, tree, held = (bucket, number), BKTree(), []
                bits = int.from_bytes(sig)
                for i in tree.search(bits, within):
                    other, its_size = held[i]
                    # Sets whose sizes differ by more than the threshold allows cannot reach it.
                    if min(size, its_size) >= threshold * max(size, its_size):
                        out.add((min(tid, other), max(tid, other)))
                if role == 0:
                    tree.add(bits, len(held))
                    held.append((tid, size))
            yield pd.DataFrame(sorted(out), columns=["tid_a", "tid_b"])

    return run


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept: dict[str, np.ndarray] = {}
    for pdf in batches:
        rows = []
        for a, b, x, y in zip(pdf["tid_a"], pdf["tid_b"], pdf["text_a"], pdf["text_b"]):
            if len(kept) > 256:
                kept.clear()
            s = kept.get(a)
            if s is None:
                s = kept[a] = shingles(x)
            t = shingles(y)
            common = len(np.intersect1d(s, t, assume_unique=True))
            rows.append((a, b, common / (len(s) + len(t) - common)))
        yield pd.DataFrame(rows, columns=["tid_a", "tid_b", "similarity"])


def similar_texts(texts: DataFrame, threshold: float = 0.8, block: int = 2000) -> DataFrame:
    """(tid_a, tid_b, similarity) for the pairs tid_a < tid_b of different texts (tid, text) that reach the threshold. Texts are normalised and distinct."""
    signed = cut(texts.mapInPandas(_signed, "tid string, sig binary, size int, buckets array<long>"))
    placed = signed.select("tid", "sig", "size", F.explode("buckets").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = placed.join(sizes, "bucket").withColumn("mine", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int"))
    # A record belongs to the tree of its own block and is looked up in the trees of the blocks up to its own.
    searches = placed.select("bucket", "tid", "sig", "size", "mine", F.explode(F.sequence(F.lit(0), F.col("mine"))).alias("tree"))
    searches = searches.select("bucket", "tree", (F.col("tree") != F.col("mine")).cast("int").alias("role"), "tid", "sig", "size")
    searches = searches.repartition("bucket", "tree").sortWithinPartitions("bucket", "tree", "role")
    found = searches.mapInPandas(_search(radius(threshold), threshold), "tid_a string, tid_b string").distinct()
    a, b = (texts.select(F.col("tid").alias(f"tid_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    pairs = found.join(b, "tid_b").join(a, "tid_a")
    return pairs.mapInPandas(_verify, "tid_a string, tid_b string, similarity double").where(F.col("similarity") >= threshold)


def near_duplicates(records: DataFrame, key: str, text: str, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(links between different texts, members (rec, tid)). Null texts and keys are left out; an empty text is a text like any other."""
    rows = records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("rec"), normalised(F.col(text)).alias("text"))
    rows = kept(rows.withColumn("tid", F.md5("text")))  # normalised once
    members = cut(rows.select("rec", "tid").distinct())
    return cut(similar_texts(kept(rows.select("tid", "text").dropDuplicates(["tid"])), threshold)), members


def pairs_of_records(links: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair (rec_a < rec_b) of records in linked or equal texts."""
    a, b = (members.select(F.col("rec").alias(f"r_{x}"), F.col("tid").alias(f"tid_{x}")) for x in "ab")
    linked = links.select("tid_a", "tid_b").join(a, "tid_a").join(b, "tid_b").where("r_a != r_b").select("r_a", "r_b")
    same = a.join(b.withColumnRenamed("tid_b", "tid_a"), "tid_a").where("r_a < r_b").select("r_a", "r_b")
    both = linked.unionByName(same)
    return both.select(F.least("r_a", "r_b").alias("rec_a"), F.greatest("r_a", "r_b").alias("rec_b")).distinct()


def groups_of_records(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row per record: rec, its class (the least text id that chains of links reach) and the number of links of its text.

    The classes come from repeated rounds in which every text takes the least label among itself and its neighbours and then the label of its label; each
    round's labels are kept in the shared folder, and the rounds end when none changes.
    """
    edges = cut(links.select(F.col("tid_a").alias("x"), F.col("tid_b").alias("y")).unionByName(links.select(F.col("tid_b").alias("x"), F.col("tid_a").alias("y"))).distinct())
    labels = cut(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("x").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near, "x").select("x", "label", F.least("label", "near").alias("next"))
        jump = step.select(F.col("x").alias("next"), F.col("next").alias("far"))
        new = cut(step.join(jump, "next", "left").select("x", "label", F.least("next", F.coalesce("far", "next")).alias("next")))
        if new.where("label != next").isEmpty():
            break
        labels = new.select("x", F.col("next").alias("label"))
    degree = edges.groupBy("x").agg(F.count("*").alias("links"))
    own = labels.join(degree, "x").withColumnRenamed("x", "tid")
    return members.join(own, "tid", "left").select("rec", F.coalesce("label", "tid").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
