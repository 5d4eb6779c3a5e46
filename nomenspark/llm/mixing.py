"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources that they belong to. Each pattern may send its words
once for nothing, a second time at cost 1, a third at cost 2 (convex), to the quotas of its sources; the cheapest flow
that fills the quotas says how often each pattern is taken. A pattern taken 1.3 times gives every document once and a
seeded three tenths of its words twice.

The seeded part is cut by histograms, not by ordering documents: a 64-bit hash of key and seed deals a pattern's
documents to 4096 buckets, whose sums say in which bucket the cut falls; that bucket alone is dealt to 4096 more. So a
source with a third of all rows is summed map-side like any other. The driver sees one row per pattern, and the plan
joined to the documents has one row per pattern; Spark broadcasts it if its size allows and else splits hot patterns.

Defined results: a null text has size 0; a null source is a source of its own, the last; a null or empty set of sources
is never taken; rows that are equal in their key share a hash; an empty table gives an empty plan; of extra columns
none is read.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, text_of

BITS = 12


def size_of(text: str = "text") -> Column:
    """Words of a text; 0 where null."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def by_code_point(sources) -> list:
    return sorted(sources, key=lambda s: (s is None, s or ""))


def water_fill(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Shares of total by weight; none above most times its size, the excess reshared by weight among the others."""
    targets, free = {}, dict(weights)
    while free:
        rest, all_weights = total - sum(targets.values()), sum(free.values())
        above = [s for s, w in free.items() if rest * w / all_weights > most * sizes[s]]
        if not above:
            return targets | {s: rest * w / all_weights for s, w in free.items()}
        for s in above:
            targets[s] = float(most * sizes[s])
            del free[s]
    return targets


@dataclass
class Flow:
    """Min-cost flow by successive shortest paths, with integer capacities and costs."""

    arcs: list[list] = field(default_factory=list)  # to, capacity left, cost; arc i ^ 1 is its reverse
    out: dict[object, list[int]] = field(default_factory=dict)

    def add(self, a, b, capacity: int, cost: int) -> int:
        for x, y, room, price in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.arcs))
            self.out.setdefault(y, [])
            self.arcs.append([y, room, price])
        return len(self.arcs) - 2

    def run(self, source, sink) -> None:
        while True:
            best, via, queue, waiting = {source: 0}, {}, deque([source]), {source}
            while queue:
                a = queue.popleft()
                waiting.discard(a)
                for i in self.out[a]:
                    b, room, cost = self.arcs[i]
                    if room > 0 and (b not in best or best[a] + cost < best[b]):
                        best[b], via[b] = best[a] + cost, i
                        if b not in waiting:
                            queue.append(b)
                            waiting.add(b)
            if sink not in best:
                return
            path, b = [], sink
            while b != source:
                path.append(via[b])
                b = self.arcs[via[b] ^ 1][0]
            push = min(self.arcs[i][1] for i in path)
            for i in path:
                self.arcs[i][1] -= push
                self.arcs[i ^ 1][1] += push


def route(patterns: dict[str, int], quotas: dict, copies: int) -> dict[str, int]:
    """Words that each pattern gives. patterns: words by JSON list of sources; quotas: words by source. A source that
    shares no pattern has one way to fill its quota, so only the others make a network: the driver's time grows with the
    overlapping patterns and their sources (some seconds for 800 of them), not with the sources of a plain mix."""
    of = {p: json.loads(p) for p in sorted(patterns)}
    shared = {s for own in of.values() if len(own) > 1 for s in own}
    net, given, plain = Flow(), {}, {}
    net.out.update({"from": [], "to": []})
    for s in by_code_point(shared):
        net.add(("source", s), "to", quotas[s], 0)
    for p, own in of.items():
        if shared.isdisjoint(own):
            plain[p] = min(quotas[own[0]], copies * patterns[p]) if own else 0
            continue
        given[p] = [net.add("from", ("pattern", p), patterns[p], k) for k in range(copies)]
        for s in own:
            net.add(("pattern", p), ("source", s), copies * patterns[p], 0)
    net.run("from", "to")
    return plain | {p: sum(net.arcs[i ^ 1][1] for i in arcs) for p, arcs in given.items()}


@dataclass
class Plan:
    """patterns: pattern, full, b1, b2, last (how to take a pattern); sources: source, source_size, target."""

    patterns: DataFrame
    sources: DataFrame


def by_weights(weigh: Callable[[int], float] = lambda i: i % 3 + 1, share: float = 1.0, most: float = 3.0):
    """Targets of sources in code point order, null last, that weigh 1, 2, 3, repeating."""

    def targets(sizes: dict, total: int) -> dict:
        return water_fill(sizes, {s: weigh(i) for i, s in enumerate(by_code_point(sizes))}, share * total, most)

    return targets


def rows_of(df: DataFrame, sources: Column, key: str, seed: int, text: str = "text") -> DataFrame:
    """df with _pattern, _size, _b1 and _b2."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    mask = (1 << BITS) - 1
    return df.withColumns({
        "_pattern": F.to_json(F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>")))), {"ignoreNullFields": "false"}),
        "_size": size_of(text),
        "_b1": F.shiftrightunsigned(h, 64 - BITS).cast("int"),
        "_b2": F.shiftrightunsigned(h, 64 - 2 * BITS).bitwiseAND(F.lit(mask)).cast("int"),
    })


def make_plan(rows: DataFrame, scratch: Scratch, targets=None, copies: int = 3) -> Plan:
    """The plan for rows_of() some documents."""
    spark = rows.sparkSession
    sized = scratch.table(rows.select("_pattern", "_size", "_b1", "_b2"), "sizes")
    first = scratch.table(sized.groupBy("_pattern", "_b1").agg(F.sum("_size").alias("words")), "buckets")
    patterns = {r._pattern: r.words for r in first.groupBy("_pattern").agg(F.sum("words").alias("words")).collect()}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in json.loads(p):
            sizes[s] = sizes.get(s, 0) + n
    total = sum(n for p, n in patterns.items() if json.loads(p))
    wanted = (targets or by_weights())(sizes, total)
    given = route(patterns, {s: round(t) for s, t in wanted.items()}, copies)
    full = {p: given[p] // patterns[p] if patterns[p] else 0 for p in patterns}
    names = sorted(patterns)
    table = spark.createDataFrame(pa.table({
        "_pattern": pa.array(names, pa.string()), "full": pa.array([full[p] for p in names], pa.int32()),
        "rest": pa.array([given[p] - full[p] * patterns[p] for p in names], pa.int64()),
    }))

    def cut(buckets: DataFrame, key: str) -> DataFrame:
        """The bucket of each pattern in which the running sum passes rest, and what rest leaves for it."""
        running = F.sum("words").over(Window.partitionBy("_pattern").orderBy(key))
        return (
            buckets.join(table, "_pattern").withColumn("upto", running)
            .where((F.col("rest") > 0) & (F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
            .select("_pattern", F.col(key).alias("at"), (F.col("rest") - F.col("upto") + F.col("words")).alias("left"), "words")
        )

    one = scratch.table(cut(first, "_b1"), "cut")
    inner = sized.join(one.select("_pattern", F.col("at").alias("_b1"), F.col("left").alias("rest_in")), ["_pattern", "_b1"])
    second = inner.groupBy("_pattern", "_b2", "rest_in").agg(F.sum("_size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("_pattern").orderBy("_b2"))
    two = (
        second.withColumn("upto", running)
        .where((F.col("upto") > F.col("rest_in")) & (F.col("upto") - F.col("words") <= F.col("rest_in")))
        .select("_pattern", F.col("_b2").alias("b2"), (2 * (F.col("rest_in") - F.col("upto") + F.col("words")) > F.col("words")).alias("last"))
    )
    how = table.join(one.select("_pattern", F.col("at").alias("b1")), "_pattern", "left").join(two, "_pattern", "left")
    how = scratch.table(how.select("_pattern", "full", F.coalesce("b1", F.lit(-1)).alias("b1"), F.coalesce("b2", F.lit(-1)).alias("b2"), F.coalesce("last", F.lit(False)).alias("last")), "plan")
    scratch.drop(sized, first, one)
    order = by_code_point(sizes)
    stats = spark.createDataFrame(pa.table({
        "source": pa.array(order, pa.string()), "source_size": pa.array([sizes[s] for s in order], pa.int64()),
        "target": pa.array([float(wanted[s]) for s in order], pa.float64()),
    }))
    return Plan(how, stats)


def take(rows: DataFrame, plan: Plan) -> DataFrame:
    """rows_of() some documents with copies, how often the mix takes each."""
    part = (F.col("_b1") < F.col("b1")) | ((F.col("_b1") == F.col("b1")) & ((F.col("_b2") < F.col("b2")) | (F.col("last") & (F.col("_b2") == F.col("b2")))))
    return rows.join(plan.patterns, "_pattern", "left").withColumn("copies", F.col("full") + part.cast("int")).drop("full", "b1", "b2", "last")
