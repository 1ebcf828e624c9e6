"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by their membership pattern (the set of sources they belong to; one source each in the plain
case). Tokens flow from patterns to source quotas: each epoch of a pattern is an arc of the pattern's size, and later
epochs cost more (epoch e costs e squared), so the cost of repetition is convex and a pattern is only repeated where
fresh tokens run out. Within a pattern's flow to its sources, documents are taken in a seeded order.

Sizes are words. The quotas share ``ratio`` times all words by weight, no quota exceeds ``epochs`` times its source's
words, and what is cut off is shared again by weight.

Selection looks at no ordered list of a source as a whole: documents fall into ``CELLS`` cells by their seeded hash, cell
totals give every cell's offset, and only the cell in which a quota ends is put in order. A pattern that is taken e
times and a part takes every document e times and those of the part once more; the last document of the part is taken
if that comes closer to the quota.

Defined results: NULL and empty texts have size 0 and are taken 0 times; a NULL source is a source of its own, last in
the order; repeated rows and NULL doc_ids are separate documents, ties in the seeded order fall by doc_id and size. Other
columns are ignored unless asked for; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

WEIGHTS = (5.0, 2.0, 1.0)
CELLS = 1 << 12
MAX_PATTERNS = 200_000  # what the driver's flow graph may hold


@F.pandas_udf(T.LongType())
def _n_words(texts: pd.Series) -> pd.Series:
    # On bytes, split() cuts at ASCII white space, as the word rule does.
    return pd.Series([len(t.split()) if t else 0 for t in texts], dtype="int64")


def size_of(text: Column) -> Column:
    return _n_words(text.cast("binary"))


def targets(sizes: DataFrame, *, ratio: float = 1.5, epochs: int = 2, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources fill up in the order of cap / weight: the first ones reach their cap, and from some source on all get the
    same share for their weight. One row per source goes through the two windows, nothing else.
    """
    # Code point order is the order of the UTF-8 bytes.
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    n = (F.row_number().over(order) - 1) % len(weights)
    w = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (n + 1).cast("int"))).withColumn("cap", epochs * F.col("source_size").cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = w.withColumn("full", F.coalesce(F.sum("cap").over(fill), F.lit(0.0))).withColumn("gone", F.coalesce(F.sum("w").over(fill), F.lit(0.0)))
    w = w.withColumn("total", ratio * F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    w = w.withColumn("level", (F.col("total") - F.col("full")) / (F.col("all_w") - F.col("gone")))
    # The level rises as long as the sources before it belong below their share, and falls afterwards.
    return w.select("source", "source_size", F.least("cap", F.max("level").over(every) * F.col("w")).alias("target"))


def route(capacity: dict, quota: dict, epochs: int = 2) -> dict:
    """Tokens from each pattern to each of its sources: {(pattern, source): tokens}.

    ``capacity``: pattern (tuple of sources) -> tokens; ``quota``: source -> tokens. Successive shortest paths:
    Dijkstra with potentials on the residual graph, whose arcs are few (one for each pattern and epoch or source). Parts of the graph that share no source are solved one by one.
    """
    by_source = defaultdict(list)
    for p in capacity:
        for s in p:
            by_source[s].append(p)
    flow: dict = {}
    left_over = set(capacity)
    while left_over:
        part, stack = set(), [next(iter(left_over))]
        while stack:
            p = stack.pop()
            if p not in part:
                part.add(p)
                stack += [q for s in p for q in by_source[s] if q not in part]
        left_over -= part
        flow |= _route_part({p: capacity[p] for p in sorted(part, key=repr)}, quota, epochs)
    return flow


def _route_part(capacity: dict, quota: dict, epochs: int) -> dict:
    edges: list[list] = []  # to, capacity, cost
    out = defaultdict(list)

    def arc(a, b, cap: float, cost: int) -> int:
        out[a].append(len(edges))
        edges.append([b, cap, cost])
        out[b].append(len(edges))
        edges.append([a, 0.0, -cost])
        return len(edges) - 2

    used: dict = {}
    for p, cap in capacity.items():
        for e in range(1, epochs + 1):
            arc("in", ("p", p), float(cap), e * e)
        for s in p:
            used[p, s] = arc(("p", p), ("s", s), float("inf"), 0)
    for s in sorted({s for p in capacity for s in p}, key=repr):
        arc(("s", s), "out", float(quota.get(s, 0.0)), 0)
    height: dict = defaultdict(float)
    while True:
        dist, came, queue, tick = {"in": 0.0}, {}, [(0.0, 0, "in")], 0
        while queue:
            d, _, v = heapq.heappop(queue)
            if d > dist[v]:
                continue
            for k in out[v]:
                b, cap, cost = edges[k]
                if cap > 1e-6:
                    nd = d + cost + height[v] - height[b]
                    if nd < dist.get(b, float("inf")) - 1e-9:
                        tick += 1
                        dist[b], came[b] = nd, k
                        heapq.heappush(queue, (nd, tick, b))
        if "out" not in dist:
            return {ps: edges[k ^ 1][1] for ps, k in used.items() if edges[k ^ 1][1] > 0}
        far = max(dist.values())
        for v in list(out):
            height[v] += dist.get(v, far)
        path, v = [], "out"
        while v != "in":
            path.append(came[v])
            v = edges[came[v] ^ 1][0]
        push = min(edges[k][1] for k in path)
        for k in path:
            edges[k][1] -= push
            edges[k ^ 1][1] += push


def mix(docs: DataFrame, *, ratio: float = 1.5, epochs: int = 2, weights: tuple[float, ...] = WEIGHTS, seed: str = "mix", sources: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, times, sources) of every row; with ``keep``, those columns as
    _keep_0 and so on in place of doc_id.

    ``sources`` names a text column (one source each) or an array column (overlapping sources; then source_size and
    target are those of all the row's sources together, and a row's words count for each of its sources' sizes). ``times``
    is how often the document is taken.
    """
    plural = dict(docs.dtypes)[sources].startswith("array")
    member = F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string"))))) if plural else F.array(F.col(sources))
    extra = [F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size_of(F.col("text")).alias("size"), member.cast("array<string>").alias("member"), *extra)
    # The seeded order: hex digits of an MD5, so that other engines and reruns agree.
    rows = rows.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    rows = rows.withColumn("cell", (F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") * CELLS / (1 << 32)).cast("int"))

    cells = cut(rows.groupBy("member", "cell").agg(F.sum("size").alias("cell_size"), F.count("*").alias("n")), "mix-cells")
    patterns = cells.groupBy("member").agg(F.sum("cell_size").alias("size"))
    by_source = patterns.select(F.explode("member").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = cut(targets(by_source, ratio=ratio, epochs=epochs, weights=weights), "mix-targets")

    if patterns.limit(MAX_PATTERNS + 1).count() > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns: group rare sources before mixing")
    capacity = {tuple(r.member): r.size for r in patterns.collect()}
    flow = route(capacity, {r.source: r.target for r in wanted.collect()}, epochs)
    quota: dict = defaultdict(float)
    for (p, _), tokens in flow.items():
        quota[p] += tokens
    schema = "member array<string>, quota double"
    session = docs.sparkSession
    quotas = cut(session.createDataFrame([(list(p), q) for p, q in sorted(quota.items(), key=repr)], schema), "mix-quotas")

    # Every cell's words before it, and the words of its pattern: the cell's share of the last, partial epoch follows.
    upto = Window.partitionBy("member").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("member")
    at = cells.withColumn("before", F.coalesce(F.sum("cell_size").over(upto), F.lit(0))).withColumn("all", F.sum("cell_size").over(whole))
    at = at.join(quotas, "member", "left").withColumn("quota", F.coalesce("quota", F.lit(0.0)))
    full = F.when(F.col("all") > 0, F.floor(F.col("quota") / F.col("all") + 1e-12)).otherwise(0)
    at = at.withColumn("full", F.least(full, F.lit(epochs)).cast("int")).withColumn("rest", F.greatest(F.col("quota") - F.col("full") * F.col("all"), F.lit(0.0)))
    at = at.withColumn("rest", F.when(F.col("full") >= epochs, 0.0).otherwise(F.col("rest"))).select("member", "cell", "before", "full", "rest")

    per_pattern = patterns.select("member", F.explode("member").alias("source")).alias("p").join(wanted.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    per_pattern = per_pattern.groupBy("p.member").agg(F.sum("t.source_size").alias("source_size"), F.sum("t.target").alias("target"))
    at = cut(at.join(per_pattern, "member"), "mix-plan")

    # The rows meet their cell's plan and are put in order inside it, a 1/4096 of their pattern. Cells before the quota's
    # end come out whole, cells behind it empty. (An array's NULL members compare equal.)
    seeded = Window.partitionBy("member", "cell").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(seeded), F.lit(0))
    met = rows.join(at, ["member", "cell"]).withColumn("more", (start + F.col("size") / 2 <= F.col("rest")).cast("int"))
    out = met.withColumn("times", F.when(F.col("size") > 0, F.col("full") + F.col("more")).otherwise(0).cast("long"))
    own = [*([] if keep else ["doc_id"]), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", F.col("member").alias("sources")]
    return out.select(*own, *[F.col(f"_keep_{i}").alias(f"_keep_{i}") for i in range(len(keep))])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns and ``repeats``, how often each is taken. A column
    of that name in ``docs`` gives way."""
    names = [c for c in docs.columns if c != "repeats"]
    out = mix(docs, keep=tuple(names), **options).where("times > 0")
    return out.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(names)], F.col("times").alias("repeats"))

