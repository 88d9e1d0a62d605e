"""Mixing sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import WORD, Scratch

#: Bits of the seeded hash that one level of bins resolves, and levels.
BITS, LEVELS = 10, 2
#: Single documents that bring a pattern nearer to its share.
SWAPS = 3


def targets(sizes: Mapping, weights: Mapping, limit: float = 3.0) -> dict:
    """Share the total size by weight; no source gets more than ``limit`` times its size.

    What a source can't take is reshared among the others by weight until none is above.
    """
    out, open_, left = {}, [s for s in sizes], float(sum(sizes.values()))
    while open_:
        total = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / total if total else 0.0 for s in open_}
        over = [s for s in open_ if share[s] > limit * sizes[s]]
        if not over:
            out |= share
            break
        for s in over:
            out[s] = float(limit * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def route(patterns: Mapping[tuple, float], quota: Mapping, epochs: int = 3) -> dict[tuple[tuple, object], float]:
    """Min-cost flow: words that each pattern gives to each of its sources.

    Nodes: a root, the patterns (sets of sources that a document belongs to) and the sources.  A
    pattern gives its size once at cost 0, again at cost 1, again at cost 2, ... up to ``epochs``
    times: convex, so new documents go before repetitions.  A source takes its quota.

    Every cost lies on an arc from the root, so the shortest augmenting paths cost 0 until there is none, then 1, and so on.
    Each of these rounds adds one repetition to what the patterns may give and augments along shortest paths
    in whole layers (blocking flows), with work near the number of arcs for a layer.  The graph has one node for
    each pattern and source, none for documents.
    """
    names, goals = list(patterns), list(quota)
    at = {s: len(names) + j for j, s in enumerate(goals)}
    arcs = [[at[s] for s in p if s in at] for p in names] + [[] for _ in goals]
    back: list[list[int]] = [[] for _ in arcs]  # patterns of a source
    for i, sources in enumerate(arcs):
        for j in sources:
            back[j].append(i)
    flow: dict[tuple[int, int], float] = {}
    give, take = [0.0] * len(names), [0.0] * len(names) + [float(quota[s]) for s in goals]
    eps = 1e-6
    for _ in range(epochs):
        give = [g + float(patterns[p]) for g, p in zip(give, names, strict=True)]
        while True:
            level = [-1] * len(arcs)
            front = [i for i in range(len(names)) if give[i] > eps]
            for i in front:
                level[i] = 0
            goal = False
            while front and not goal:
                following = []
                for i in front:
                    for j in arcs[i] if i < len(names) else [p for p in back[i] if flow.get((p, i), 0.0) > eps]:
                        if level[j] < 0:
                            level[j] = level[i] + 1
                            following.append(j)
                            goal = goal or take[j] > eps
                front = following
            if not goal:
                break
            rest = [iter(arcs[i]) if i < len(names) else iter(back[i]) for i in range(len(arcs))]
            for start in range(len(names)):
                while give[start] > eps and level[start] == 0:
                    path = [start]
                    while path and take[path[-1]] <= eps:
                        i = path[-1]
                        for j in rest[i]:
                            if level[j] == level[i] + 1 and (i < len(names) or flow.get((j, i), 0.0) > eps):
                                path.append(j)
                                break
                        else:
                            level[path.pop()] = -1  # a dead end
                    if not path:
                        break
                    steps = list(zip(path, path[1:], strict=False))
                    push = min([give[start], take[path[-1]], *[flow[j, i] for i, j in steps if i >= len(names)]])
                    for i, j in steps:
                        if i < len(names):
                            flow[i, j] = flow.get((i, j), 0.0) + push
                        else:
                            flow[j, i] -= push
                    give[start] -= push
                    take[path[-1]] -= push
                    for i in path:  # what a search passed over may be open still
                        rest[i] = iter(arcs[i]) if i < len(names) else iter(back[i])
    return {(names[i], goals[j - len(names)]): f for (i, j), f in flow.items() if f > eps}


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(
    docs: DataFrame,
    weights: Mapping | Sequence[float] = (1, 2, 3),
    source: str = "source",
    limit: int = 3,
    seed: int = 17,
    max_patterns: int = 1_000_000,
) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken``: how often the mix takes each row.

    ``source`` names a column with one source or an array of them (overlapping sources).  ``weights`` is a mapping, or a
    sequence repeated over the sources in code-point order, null last.  Sizes are words.

    1. One scan keeps (pattern, seeded hash, size) of each row, in a narrow table.
    2. Patterns are summed; the flow network (:func:`route`), of patterns and sources only, is
       solved on the driver.  It needs some 500 bytes a pattern there; more than ``max_patterns`` patterns raise an error, none is left out.
    3. A pattern that gives q times its size gives every document floor(q) times, and the rest to the
       documents whose hash is below a threshold.  The threshold comes from 1,024 sums for each pattern, then 1,024 inside the bin where the
       rest runs out, then that bin's documents (one in a million of the pattern).  No source is gathered in one task.
       At last ``SWAPS`` documents, each of the size nearest to what is missing or too much, are added or dropped.
    4. The choice is a lookup of the row's pattern (at most ``max_patterns`` rows): no shuffle of texts.

    For a row of several sources, ``source_size`` and ``target`` are sums over its sources, each counted as in step 2.  Null or
    empty texts have size 0 and no copy.  Equal (doc_id, text) rows hash alike and are taken alike.  Very long texts are one document like
    others.  Input columns named like the added ones are replaced, all others stay; an empty table gives no row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    is_array = docs.schema[source].dataType.typeName() == "array"
    member = F.array_sort(F.array_distinct(F.col(source).cast("array<string>"))) if is_array else F.array(F.col(source).cast("string"))
    size = word_count()
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.xxhash64("text")), 1)
    narrow = scratch.table(docs.select(member.alias("pattern"), h.alias("h"), size.alias("size")), "sizes")
    found = narrow.groupBy("pattern").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    sizes = {tuple(r["pattern"]): r["size"] for r in found if r["pattern"] is not None}
    names = sorted({s for p in sizes for s in p}, key=lambda s: (s is None, s or ""))
    per_source = dict.fromkeys(names, 0)
    for p, n in sizes.items():
        for s in p:
            per_source[s] += n
    if not isinstance(weights, Mapping):
        weights = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal = targets(per_source, {s: weights.get(s, 0) for s in names}, limit)
    flow = route(sizes, goal, limit)
    plan, given = [], dict.fromkeys(sizes, 0.0)
    for (p, _), f in flow.items():
        given[p] += f
    for p, n in sizes.items():
        out = given[p]
        base = min(limit, int(out // n)) if n else 0
        rest = min(out - base * n, float(n)) if base < limit else 0.0
        plan.append((list(p), base, rest, sum(per_source[s] for s in p), float(sum(goal[s] for s in p))))
    kinds = (pa.list_(pa.string()), pa.int32(), pa.float64(), pa.int64(), pa.float64())
    columns = [pa.array([row[i] for row in plan], kind) for i, kind in enumerate(kinds)]
    # as an Arrow table, since executors start Python workers of another kind for plain rows and keep them
    quota = spark.createDataFrame(pa.table(columns, ["pattern", "base", "rest", "source_size", "target"]))
    quota = F.broadcast(quota)  # at most max_patterns rows
    # Threshold of each pattern: the bin in which its rest runs out, that bin's own bins, then documents.
    some = narrow.where("size > 0")
    edge = quota.where("rest > 0").select("pattern", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("before"), "rest")
    for level in range(1, LEVELS + 1):
        inside = some.withColumn("prefix", F.shiftright("h", 63 - (level - 1) * BITS)).join(F.broadcast(edge), ["pattern", "prefix"])
        sums = inside.groupBy("pattern", "before", "rest", F.shiftright("h", 63 - level * BITS).alias("bin")).agg(F.sum("size").alias("n"))
        earlier = F.expr("before + coalesce(sum(n) OVER (PARTITION BY pattern ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
        sums = sums.withColumn("earlier", earlier).where("earlier < rest AND earlier + n >= rest")
        edge = scratch.table(sums.select("pattern", F.col("bin").alias("prefix"), F.col("earlier").alias("before"), "rest"), f"edge-{level}")
    inside = some.withColumn("prefix", F.shiftright("h", 63 - LEVELS * BITS)).join(F.broadcast(edge), ["pattern", "prefix"])
    inside = inside.groupBy("pattern", "before", "rest", "h").agg(F.sum("size").alias("n"))
    upto = F.expr("before + sum(n) OVER (PARTITION BY pattern ORDER BY h)")
    # the document in which the rest runs out is taken when that comes nearer to the target
    cut = inside.withColumn("upto", upto).where("upto - n / 2 <= rest").groupBy("pattern").agg(F.max("h").alias("cut"))
    floor_ = edge.select("pattern", (F.shiftleft("prefix", 63 - LEVELS * BITS) - 1).alias("low"))
    cut = floor_.join(cut, "pattern", "left").select("pattern", F.coalesce("cut", "low").alias("cut"))
    table = scratch.table(quota.join(cut, "pattern", "left"), "threshold")
    # Single documents whose size is nearest to what is missing or too much.
    below = F.coalesce(F.col("h") <= F.col("cut"), F.lit(False))
    got = some.join(F.broadcast(table), "pattern").where("rest > 0").groupBy("pattern").agg(F.sum(F.when(below, F.col("size")).otherwise(0)).alias("got"))
    table = table.join(got, "pattern", "left").withColumn("missing", F.coalesce(F.col("rest") - F.col("got"), F.lit(0.0)))
    table = scratch.table(table.select("*", *[F.expr("CAST(array() AS array<bigint>)").alias(c) for c in ("added", "dropped")]), "step-0")
    off = F.abs(F.abs("missing") - F.col("size"))
    fits = (below == (F.col("missing") < 0)) & (off < F.abs("missing")) & ~F.array_contains("added", F.col("h")) & ~F.array_contains("dropped", F.col("h"))
    for i in range(1, SWAPS + 1):
        swap = some.join(F.broadcast(table), "pattern").where(fits).groupBy("pattern").agg(F.min(F.struct(off.alias("off"), "h", "size")).alias("x"))
        add = F.col("x").isNotNull() & (F.col("missing") > 0)
        drop = F.col("x").isNotNull() & (F.col("missing") < 0)
        table = table.join(swap, "pattern", "left").select(
            *[c for c in table.columns if c not in ("missing", "added", "dropped")],
            F.when(add, F.array_append("added", F.col("x.h"))).otherwise(F.col("added")).alias("added"),
            F.when(drop, F.array_append("dropped", F.col("x.h"))).otherwise(F.col("dropped")).alias("dropped"),
            F.when(add, F.col("missing") - F.col("x.size")).when(drop, F.col("missing") + F.col("x.size")).otherwise(F.col("missing")).alias("missing"),
        )
        table = scratch.table(table, f"step-{i}")
    chosen = (F.coalesce(F.col("__h") <= F.col("__c.cut"), F.lit(False)) | F.array_contains("__c.added", F.col("__h"))) & ~F.array_contains("__c.dropped", F.col("__h"))
    copies = F.when(F.col("__size") > 0, F.col("__c.base") + chosen.cast("int")).otherwise(0)
    choice = F.broadcast(table.select(F.col("pattern").alias("__q"), F.struct("base", "cut", "added", "dropped", "source_size", "target").alias("__c")))
    own = docs.withColumn("__p", member).withColumn("__h", h).withColumn("__size", size)
    keys = [F.transform("__p", lambda x: F.coalesce(x, F.lit("\0null"))), F.transform("__q", lambda x: F.coalesce(x, F.lit("\0null")))]
    out = own.join(choice, keys[0] == keys[1], "left")
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    return out.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col("__size").alias("size"),
        F.coalesce("__c.source_size", F.lit(0)).cast("long").alias("source_size"),
        F.coalesce("__c.target", F.lit(0.0)).alias("target"),
        F.coalesce(copies, F.lit(0)).alias("copies"),
        (F.coalesce(copies, F.lit(0)) * F.col("__size")).cast("long").alias("taken"),
    )
