"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document is a distinct text; where copies of it stand in several sources it may serve any of them. Documents are summed up by membership pattern (the set of
their sources), and for each plan tokens flow from patterns through sources to quotas: a pass over a pattern costs more than the pass before (convex costs),
so nothing is repeated while something unused would serve as well. The flow is solved on these few sums; the documents are then selected on Spark, in a seeded
order: the documents of a pattern lie on a ring of their tokens, each source owns an arc of it (perhaps of several laps), and a document is used once for every
time the arc passes its place.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.session import cut

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenisation pattern that belongs to these ranks.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Parts of the hash order within a pattern; only their sums are scanned in order.
BUCKETS = 16_384
#: More membership patterns than this are refused: their sums go to the driver.
MOST_PATTERNS = 100_000


def token_counter(ranks_file: str = RANKS):
    """A column function: the number of tokens of a text in a public byte-level vocabulary; null for null, 0 for an empty text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(ranks_file).read_bytes().splitlines())}
        encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield texts.map(lambda t: len(encoding.encode_ordinary(t)), na_action="ignore")

    return F.pandas_udf(run, "long")


def source_name(source: Column) -> Column:
    """One spelling of a source: lower case, trimmed, words joined by underscores; null and blank stay without a name."""
    name = F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_")
    return F.when(name != "", name)


def least_cost_flow(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens from each pattern to each source: as much of the quotas as can be met, with the least cost of repetition.

    Successive shortest paths with potentials, over a graph of as many nodes as there are patterns and sources.
    """
    names = sorted(quotas)
    used = {p: tuple(s for s in p if s in quotas) for p in sorted(patterns)}
    nodes = ["from", "to", *[("p", p) for p in used if used[p]], *[("s", s) for s in names]]
    at = {n: i for i, n in enumerate(nodes)}
    graph: list[list[list[int]]] = [[] for _ in nodes]  # [to, room, cost, position of the way back]

    def arc(a, b, room: int, cost: int) -> list[int]:
        a, b = at[a], at[b]
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])
        return graph[a][-1]

    flows = {}
    for p, own in used.items():
        if own:
            for lap in range(max(repeats[s] for s in own)):
                arc("from", ("p", p), patterns[p], lap)
            for s in own:
                flows[p, s] = (arc(("p", p), ("s", s), room := patterns[p] * repeats[s], 0), room)
    for s in names:
        arc(("s", s), "to", quotas[s], 0)
    height = [0] * len(nodes)
    while True:
        dist, came = [float("inf")] * len(nodes), [None] * len(nodes)
        dist[0] = 0
        heap = [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for i, (b, room, cost, _) in enumerate(graph[a]):
                if room > 0 and (new := d + cost + height[a] - height[b]) < dist[b]:
                    dist[b], came[b] = new, (a, i)
                    heapq.heappush(heap, (new, b))
        if came[1] is None:
            return {k: most - e[1] for k, (e, most) in flows.items() if most > e[1]}
        height = [h + d if d < float("inf") else h for h, d in zip(height, dist)]
        path, b = [], 1
        while b:
            a, i = came[b]
            path.append(graph[a][i])
            b = a
        push = min(e[1] for e in path)
        for e in path:
            e[1] -= push
            graph[e[0]][e[3]][1] += push


def sized_documents(docs: DataFrame, key: str, text: str, source: str, ranks_file: str = RANKS) -> DataFrame:
    """One row for each distinct text with tokens: doc (its least key), pattern (sorted sources), tokens, copies (rows that hold it). Kept in the shared folder.

    Null texts and texts without tokens are left out, as they add nothing to any share; a text of which no row has a source has an empty pattern.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.md5(text).alias("tid"), source_name(F.col(source)).alias("source"), token_counter(ranks_file)(F.col(text)).alias("tokens"))
    one = rows.groupBy("tid").agg(F.min("doc").alias("doc"), F.array_sort(F.collect_set("source")).alias("pattern"), F.max("tokens").alias("tokens"), F.count("*").alias("copies"))
    return cut(one.where("tokens > 0").select("doc", "tid", "pattern", "tokens", "copies"))


def held_quotas(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int], steps: int = 20) -> dict[str, int]:
    """The greatest quotas in the given relation, none above the given ones, that all can be met at once, found by halving to one part in 2**steps.

    Sources that can give nothing at all keep their quota and do not hold the others back.
    """
    live = {s for s in quotas if repeats[s] and quotas[s] and any(s in p and n for p, n in patterns.items())}
    part = lambda k: {s: q * k // 2**steps if s in live else q for s, q in quotas.items()}
    low, high = 0, 2**steps + 1
    while high - low > 1:
        middle = (low + high) // 2
        wanted = part(middle)
        flow = least_cost_flow(patterns, {s: wanted[s] for s in live}, repeats)
        low, high = (middle, high) if sum(flow.values()) == sum(wanted[s] for s in live) else (low, middle)
    return part(low)


def allotments(sized: DataFrame, targets: DataFrame, hold: str = "size") -> DataFrame:
    """(plan, source, pattern, arc_start, arc_tokens, lap_tokens, quota) for every plan of targets (plan, source, target_share, max_repeats, size_factor).

    Shares are relative weights. Where a source cannot fill its quota within its repeats there are two ways: to ``hold`` the "size", that source gives all it
    may and the other quotas stay, so that the mix keeps what it can of the wanted size; to hold the "shares", all quotas are lowered alike until every source
    that has any tokens can fill its own. Null or negative shares and repeats count as 0.
    """
    if hold not in ("size", "shares"):
        raise ValueError(f"hold is size or shares, not {hold}")
    sums = sized.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("all_tokens"))
    rows = sums.limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    patterns = {tuple(r.pattern): r.tokens for r in rows}
    corpus = sum(r.all_tokens for r in rows)
    plans: dict[str, list] = {}
    wanted = targets.where("plan IS NOT NULL").select("plan", source_name(F.col("source")).alias("source"), "target_share", "max_repeats", "size_factor").where("source IS NOT NULL").distinct()
    for r in wanted.collect():
        plans.setdefault(r.plan, []).append(r)
    out = []
    for plan, lines in sorted(plans.items()):
        share = {r.source: max(r.target_share or 0.0, 0.0) for r in lines}
        repeats = {r.source: max(r.max_repeats or 0, 0) for r in lines}
        size = max(r.size_factor or 0.0 for r in lines) * corpus
        quota = {s: round(size * x / (sum(share.values()) or 1)) for s, x in share.items()}
        if hold == "shares":
            quota = held_quotas(patterns, quota, repeats)
        flow = least_cost_flow(patterns, quota, repeats)
        reached: dict[tuple[str, ...], int] = {}
        for s in sorted(quota):
            own = [(p, n) for (p, x), n in sorted(flow.items()) if x == s]
            for p, n in own or [((), 0)]:
                out.append((plan, s, list(p), reached.get(p, 0), n, patterns.get(p, 0), quota[s], share[s] / (sum(share.values()) or 1), repeats[s]))
                reached[p] = reached.get(p, 0) + n
    schema = "plan string, source string, pattern array<string>, arc_start long, arc_tokens long, lap_tokens long, quota long, target_share double, max_repeats int"
    return sized.sparkSession.createDataFrame(out, schema)


def selected_documents(sized: DataFrame, arcs: DataFrame, seed: int = 7) -> DataFrame:
    """(plan, doc, source, repeats, tokens): each document that a plan uses for a source, how often, and its tokens in one use."""
    order = F.xxhash64("tid", F.lit(seed))
    rows = sized.where(F.size("pattern") > 0).select("doc", "tid", "pattern", "tokens", order.alias("h")).withColumn("bucket", F.shiftrightunsigned(F.col("h"), 64 - (BUCKETS.bit_length() - 1)))
    sums = rows.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("n"))
    base = sums.select("pattern", "bucket", (F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("pattern", "bucket").orderBy("h", "tid").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(base, ["pattern", "bucket"])
    placed = placed.select("doc", "pattern", "tokens", (F.col("base") + F.col("within")).alias("place"))
    # A row for each plan, pattern and source: broadcast where Spark finds it small enough, else joined with the hot patterns split by adaptive execution.
    live = arcs.where("arc_tokens > 0").select("plan", "source", "pattern", "arc_start", "arc_tokens", "lap_tokens")
    upto = lambda end: F.ceil((end - F.col("place")) / F.col("lap_tokens"))
    chosen = placed.join(live, "pattern").withColumn("repeats", (upto(F.col("arc_start") + F.col("arc_tokens")) - upto(F.col("arc_start"))).cast("int"))
    return chosen.where("repeats > 0").select("plan", "doc", "source", "repeats", "tokens")


def reached_shares(chosen: DataFrame, arcs: DataFrame) -> DataFrame:
    """For each plan and source: target_share, quota, tokens reached, share (of the plan's tokens), documents, uses and the most uses of one document."""
    got = chosen.groupBy("plan", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.sum("repeats").alias("uses"), F.max("repeats").alias("most_uses"))
    lines = arcs.select("plan", "source", "target_share", "max_repeats", "quota").distinct().join(got, ["plan", "source"], "left").fillna(0, ["tokens", "documents", "uses", "most_uses"])
    share = F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy("plan")), F.lit(0))
    return lines.withColumn("share", F.round(F.coalesce(share, F.lit(0.0)), 6))
