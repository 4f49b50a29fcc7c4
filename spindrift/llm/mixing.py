"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources that they
belong to). Each pattern offers its tokens once free of cost, a second time at
cost 1, a third at cost 2 and so on: convex repetition costs. The flow routes
this capacity to the sources' quotas at the least cost, and each pattern's
flow is then met by whole passes over its documents plus documents in the
order of a seeded hash until the rest is reached (to half a document). The
order is total but for equal rows: hash of the id, size, hash of the row.

The driver holds one row per source and per pattern, at most MOST_PATTERNS
(beyond, an error asks for coarser sources); documents never reach it. A null
source is a source of its own, which comes last. Documents without tokens
are taken as often as their pattern's passes, with nothing. Equal rows (in all
but columns with maps) are interchangeable, and as many are taken in every
run. Other columns are carried along; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.storage import discard, staged

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
MOST_PATTERNS = 20_000
#: Hexadecimal digits of a document's place, and those by whose values a pattern's documents are summed at a time; only the range where the cut falls is looked into.
PLACE_DIGITS, RANGE_DIGITS = 64, 3
#: A range with at most so many different rows is put in order.
CUT_ROWS = 20_000
SEED = 17


def words_in(text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, weights: Sequence[float] = WEIGHTS, most: float = MOST_EPOCHS) -> dict:
    """Share of all sizes by weight, in the sources' order; none above most times its size, the excess reshared."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    total, full, out = float(sum(sizes.values())), set(), {}
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(most * sizes[s] for s in full)
        shared = sum(weight[s] for s in free)
        out = {s: float(most * sizes[s]) if s in full else rest * weight[s] / shared for s in order}
        over = [s for s in free if out[s] > most * sizes[s]]
        if not over:
            return out
        full |= set(over)


def route(patterns: dict[tuple, int], quotas: dict, most: int = MOST_EPOCHS) -> dict[tuple, int]:
    """Tokens that each pattern gives to each source, {(pattern, source): tokens}: successive cheapest paths."""
    nodes = {x: i for i, x in enumerate([("from",), ("to",), *(("p", p) for p in patterns), *(("s", s) for s in quotas)])}
    arcs: list[list] = []  # to, capacity left, cost; an arc's reverse is its neighbour
    out: list[list[int]] = [[] for _ in nodes]

    def arc(a, b, capacity, cost):
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            out[nodes[x]].append(len(arcs))
            arcs.append([nodes[y], c, w])

    for p, tokens in patterns.items():
        for epoch in range(most):
            arc(("from",), ("p", p), tokens, epoch)
    links = {}
    for p, tokens in patterns.items():
        for s in p:
            links[p, s] = len(arcs)
            arc(("p", p), ("s", s), most * tokens, 0)
    for s, quota in quotas.items():
        arc(("s", s), ("to",), quota, 0)
    while True:
        cost, queue = {0: 0}, deque([0])
        while queue:
            x = queue.popleft()
            for i in out[x]:
                y, left, w = arcs[i]
                if left > 0 and cost[x] + w < cost.get(y, 1 << 60):
                    cost[y] = cost[x] + w
                    queue.append(y)
        if 1 not in cost:
            return {k: arcs[i ^ 1][1] for k, i in links.items()}
        while _filled(arcs, out, cost):
            pass


def _filled(arcs: list[list], out: list[list[int]], cost: dict[int, int]) -> bool:
    """Fills the shortest of the cheapest paths from node 0 to node 1; false if there is none left."""
    level, queue = {0: 0}, deque([0])
    while queue:
        x = queue.popleft()
        for i in out[x]:
            y, left, w = arcs[i]
            if left > 0 and y not in level and cost.get(y) == cost[x] + w:
                level[y] = level[x] + 1
                queue.append(y)
    if 1 not in level:
        return False
    rest = [iter(arcs_of) for arcs_of in out]
    path: list[int] = []
    while True:
        x = arcs[path[-1]][0] if path else 0
        if x == 1:
            step = min(arcs[i][1] for i in path)
            for i in path:
                arcs[i][1] -= step
                arcs[i ^ 1][1] += step
            full = next(k for k, i in enumerate(path) if not arcs[i][1])
            del path[full:]
            continue
        for i in rest[x]:
            y, left, w = arcs[i]
            if left > 0 and level.get(y) == level[x] + 1 and cost.get(y) == cost[x] + w:
                path.append(i)
                break
        else:
            if not path:
                return True
            path.pop()


def mix(
    docs: DataFrame, sources: Column, size: Column, seed: int = SEED, weights=WEIGHTS, most: int = MOST_EPOCHS
) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as a struct ``row``, with size, pattern, and taken: tokens the mix takes, a multiple of size.

    sources: an array column of each row's sources. docs is read twice. The
    second frame has source, source_size and target of each source.
    """
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        size.cast("long").alias("size"),
        F.array_sort(F.array_distinct(sources)).alias("pattern"),
        F.concat(key, *[F.lpad(F.hex(x), 16, "0") for x in (size.cast("long"), F.xxhash64(*plain))]).alias("place"),
    )
    sizes_of = base.groupBy("pattern", "place", "size").agg(F.count("*").alias("copies"))
    sizes_of = staged(sizes_of.withColumn("tokens", F.col("size") * F.col("copies")), "sizes")
    found = sizes_of.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    patterns = {tuple(r["pattern"]): r["tokens"] for r in found}
    sizes: dict = {}
    for p, tokens in patterns.items():
        for s in p:  # what several sources hold counts in equal parts
            sizes[s] = sizes.get(s, 0) + (tokens if len(p) == 1 else tokens / len(p))
    target = targets(sizes, weights, most)
    flow = route(patterns, {s: math.floor(t + 0.5) for s, t in target.items()}, most)
    plan = []
    for p, tokens in patterns.items():
        give = sum(flow[p, s] for s in p)
        passes = min(most, give // tokens) if tokens else 0
        plan.append((list(p), int(passes), int(give - passes * tokens)))
    spark = docs.sparkSession
    planned = spark.createDataFrame(plan, "pattern array<string>, passes long, rest long")
    # a row for each pattern, so at most MOST_PATTERNS
    cuts = staged(planned.join(_cuts(sizes_of, planned), "pattern", "left"), "cuts")
    discard(sizes_of)
    divided = not cuts.where(F.col("cut.some").between(1, F.col("cut.copies") - 1)).isEmpty()
    rows = base.join(F.broadcast(cuts), "pattern")
    here = F.coalesce((F.col("place") == F.col("cut.place")) & F.col("cut.some").between(1, F.col("cut.copies") - 1), F.lit(False))
    before = F.coalesce(F.col("place") < F.col("cut.place"), F.lit(False))
    at = F.coalesce(F.col("place") == F.col("cut.place"), F.lit(False)) & (F.col("cut.some") > 0)
    whole = rows.where(~here).select("row", "size", "pattern", "passes", (before | at).cast("long").alias("extra"))
    # copies of one row, of which some are taken: the row is written out again
    split = rows.where(here).groupBy("pattern").agg(*[F.first(c).alias(c) for c in ("row", "size", "passes")], F.first("cut").alias("cut"))
    split = split.select("row", "size", "pattern", "passes", F.explode(F.sequence(F.lit(1).cast("long"), "cut.copies")).alias("nth"), F.col("cut.some").alias("some"))
    split = split.select("row", "size", "pattern", "passes", (F.col("nth") <= F.col("some")).cast("long").alias("extra"))
    times = F.col("passes") + F.when(F.col("passes") < most, F.col("extra")).otherwise(0)
    result = (whole.unionByName(split) if divided else whole).select("row", "size", "pattern", times.alias("times"))
    shown = [(s, float(sizes[s]), float(target[s])) for s in sizes]
    report = spark.createDataFrame(shown, "source string, source_size double, target double")
    return result.withColumn("taken", F.col("times") * F.col("size")), report


def _cuts(sizes_of: DataFrame, planned: DataFrame) -> DataFrame:
    """pattern, cut: place, copies, and how many of these copies (some) are still taken, where a pattern's documents in order reach its rest.

    The cut is narrowed down by further digits of the place, so what is put in order is at most about CUT_ROWS rows of a pattern.
    """
    inside = sizes_of.join(F.broadcast(planned.select("pattern", "rest")), "pattern")
    digits = RANGE_DIGITS
    while True:
        span = F.substring("place", 1, digits)
        summed = inside.groupBy("pattern", "rest", span.alias("span")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
        before = F.sum("tokens").over(Window.partitionBy("pattern").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
        upto = summed.withColumn("before", F.coalesce(before, F.lit(0)))
        found = upto.where(F.col("before") + F.col("tokens") > F.col("rest")).groupBy("pattern").agg(F.min(F.struct("span", "before", "n")).alias("in"))
        found = staged(found.select("pattern", F.col("in.span").alias("span"), F.col("in.before").alias("skipped"), F.col("in.n").alias("n")), "spans")
        inside = inside.join(F.broadcast(found.select("pattern", "span", "skipped")), "pattern").where(span == F.col("span"))
        inside = inside.select("pattern", "place", "size", "copies", "tokens", (F.col("rest") - F.col("skipped")).alias("rest"))
        if digits >= PLACE_DIGITS or (found.agg(F.max("n")).first()[0] or 0) <= CUT_ROWS:
            break
        digits += RANGE_DIGITS
    before = F.sum("tokens").over(Window.partitionBy("pattern").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    at = inside.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") + F.col("tokens") > F.col("rest"))
    some = F.floor((F.col("rest") - F.col("before")) / F.col("size") + 0.5).alias("some")
    return at.groupBy("pattern").agg(F.min(F.struct("place", "copies", some)).alias("cut"))


def by_source(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, each in its one source."""
    own = F.array(F.col("source").cast("string"))
    mixed, report = mix(docs.select("doc_id", "text", "source"), own, words_in())
    source = F.col("row.source").cast("string")
    joined = mixed.join(F.broadcast(report.limit(MOST_PATTERNS)), source.eqNullSafe(report["source"]))
    return joined.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "size",
        F.col("source_size").cast("long").alias("source_size"), F.round("target", 6).alias("target"), "taken",
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, each as often as it takes them."""
    mixed, _ = mix(docs, F.array(F.col("source").cast("string")), words_in())
    return mixed.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
