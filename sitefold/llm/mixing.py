"""Mixing overlapping sources to target weights by min-cost flow.

A document belongs to one or more sources (here its source and its language). Documents are aggregated by membership
pattern; token capacity flows from pattern to source quotas. The first pass over a pattern costs nothing, the r-th
repetition costs r - 1, a convex cost, so that repetition is spread as evenly as the quotas allow; no pattern is used
more than MOST_PASSES times. Without a token budget EPOCHS times the corpus's tokens are asked for, or the smallest budget at
which the flow can use every document once if that is more: clean documents aren't lost, and documents of scarce sources
are repeated. With a smaller budget documents are dropped.

The flow gives each pattern whole passes and a rest; the rest is filled with documents in the order of a seeded hash up
to the nearest document. The order is found in two steps (a histogram of the hash, then the one bucket that holds the
end), so no pattern is ever sorted as a whole; documents are chosen by comparing their own hash, without a join.

Defined results: null source and language count as the source "unknown"; null and empty texts have no tokens and stay,
once; very long texts are counted whole; equal hashes (repeated rows) are chosen together, and of two ends equally near the
later one counts; weights of 0 or less count as none, and documents of which no source has a weight aren't chosen; an empty
table gives an empty table; other columns stay, and new ones that would clash get an underscore in front.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, free_name
from .token_counts import with_token_counts
from .tokenizer import VOCABULARY

ALPHA = 0.8
MOST_PASSES = 4
EPOCHS = 1.5
SEED = 17
BUCKETS = 1024
#: Membership patterns above which the plan is refused: the flow is solved on the driver.
PATTERN_LIMIT = 50_000


def memberships(docs: DataFrame, columns: tuple[str, ...] = ("source", "lang")) -> Column:
    """Sorted names of the sources that a row belongs to."""
    return F.array_sort(F.array_distinct(F.array(*(F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("unknown"))) for c in columns))))


class Flow:
    """Min-cost flow by successive shortest paths, in whole numbers."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def add(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> tuple[int, int]:
        """Flow and cost. Costs of arcs aren't negative at the start, so node prices keep them so (Dijkstra), and each
        round saturates all arcs of zero reduced cost (blocking flow)."""
        import heapq

        n, total, paid = len(self.out), 0, 0
        price = [0] * n
        while True:
            far = [None] * n
            far[s] = 0
            heap = [(0, s)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    if self.room[e] > 0:
                        y = self.to[e]
                        m = d + self.cost[e] + price[x] - price[y]
                        if far[y] is None or m < far[y]:
                            far[y] = m
                            heapq.heappush(heap, (m, y))
            if far[t] is None:
                return total, paid
            for x in range(n):
                price[x] += far[x] if far[x] is not None else far[t]
            while True:  # blocking flow over arcs of zero reduced cost, by levels
                level = [-1] * n
                level[s], queue = 0, [s]
                for x in queue:
                    for e in self.out[x]:
                        y = self.to[e]
                        if self.room[e] > 0 and level[y] < 0 and self.cost[e] + price[x] - price[y] == 0:
                            level[y] = level[x] + 1
                            queue.append(y)
                if level[t] < 0:
                    break
                at = [0] * n
                while True:
                    path, x = [], s
                    while x != t:
                        while at[x] < len(self.out[x]):
                            e = self.out[x][at[x]]
                            y = self.to[e]
                            if self.room[e] > 0 and level[y] == level[x] + 1 and self.cost[e] + price[x] - price[y] == 0:
                                break
                            at[x] += 1
                        if at[x] < len(self.out[x]):
                            path.append(self.out[x][at[x]])
                            x = self.to[path[-1]]
                        elif path:
                            e = path.pop()
                            x = self.to[e ^ 1]
                            at[x] += 1
                        else:
                            break
                    if x != t:
                        break
                    push = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= push
                        self.room[e ^ 1] += push
                        paid += push * self.cost[e]
                    total += push


@dataclass
class Plan:
    budget: int
    quotas: dict[str, int]
    used: list[int]  # tokens of each pattern, repetitions included
    routed: dict[tuple[int, str], int]


def target_weights(patterns: list[tuple[tuple[str, ...], int]], alpha: float = ALPHA) -> dict[str, Fraction]:
    """Weights of the sources by their tokens to the power of alpha, scaled to 1."""
    size: dict[str, int] = {}
    for names, tokens in patterns:
        for x in names:
            size[x] = size.get(x, 0) + tokens
    raw = {x: max(1, round((n**alpha) * 1000)) if n else 0 for x, n in sorted(size.items())}
    total = sum(raw.values())
    return {x: Fraction(n, total) for x, n in raw.items()} if total else {}


def solve(patterns: list[tuple[tuple[str, ...], int]], weights: dict[str, Fraction], budget: int, passes: int) -> Plan:
    """Routes at most `budget` tokens from patterns (their sources and tokens) to source quotas."""
    quotas = {x: int(budget * w) for x, w in weights.items()}
    names = list(quotas)
    at = {x: 2 + len(patterns) + k for k, x in enumerate(names)}
    g = Flow(2 + len(patterns) + len(names))
    supply, route = [], {}
    for k, (member, tokens) in enumerate(patterns):
        supply.append([g.add(0, 2 + k, tokens, r) for r in range(passes)])
        for x in member:
            if x in at:
                route[k, x] = g.add(2 + k, at[x], tokens * passes, 0)
    for x in names:
        g.add(at[x], 1, quotas[x], 0)
    g.run(0, 1)
    flow = lambda e: g.room[e ^ 1]
    return Plan(budget, quotas, [sum(map(flow, s)) for s in supply], {k: flow(e) for k, e in route.items() if flow(e)})


def least_budget(patterns: list[tuple[tuple[str, ...], int]], weights: dict[str, Fraction]) -> int:
    """The smallest budget, to about a thousandth, at which the quotas can take every token once of patterns with a weighted source."""
    total = sum(n for member, n in patterns if any(x in weights for x in member))
    if not total:
        return 0
    # integer quotas lose less than one token each
    enough = lambda b: sum(solve(patterns, weights, b, 1).used) >= total
    low, high = total, total
    while not enough(high + len(weights)):
        low, high = high, high * 2
    while high - low > max(1, total // 1000):
        mid = (low + high) // 2
        low, high = (low, mid) if enough(mid + len(weights)) else (mid, high)
    return high + len(weights)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, alpha: float = ALPHA, passes: int = MOST_PASSES, seed: int = SEED, sources: tuple[str, ...] = ("source", "lang"), doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> tuple[DataFrame, Plan]:
    """docs with a column n_copies (0: not chosen), and the plan. weights: source name, as in memberships(), to weight."""
    names = docs.columns
    member, order, copies = (free_name(names, x) for x in ("_member", "_order", "n_copies"))
    # the text is part of the key, so rows without a doc_id differ too
    key = F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    marked = docs.withColumns({member: F.concat_ws("\x1f", memberships(docs, sources)), order: key})
    counted = with_token_counts(marked.select(F.col(member).alias("m"), F.col(order).alias("h"), F.col(f"`{text}`").alias("text")), "text", "n", vocabulary, keep=["m", "h"])
    stored = cut(counted.select("m", "h", F.coalesce("n", F.lit(0)).alias("n"), F.shiftrightunsigned("h", 54).cast("int").alias("b")))
    histogram = stored.groupBy("m", "b").agg(F.sum("n").alias("n")).where("n > 0")
    sums = histogram.groupBy("m").agg(F.sum("n").alias("n"))
    if sums.count() > PATTERN_LIMIT:
        raise ValueError(f"more than {PATTERN_LIMIT} membership patterns")
    found = sorted((r["m"], r["n"]) for r in sums.collect())
    patterns = [(tuple(m.split("\x1f")), int(n)) for m, n in found]
    if not patterns:
        return docs.withColumn(copies, F.lit(1)), Plan(0, {}, [], {})
    if weights is None:
        w = target_weights(patterns, alpha)
    else:
        given = {x: Fraction(v).limit_denominator(10**9) for x, v in weights.items() if v > 0}
        w = {x: v / sum(given.values()) for x, v in given.items()}
    if budget is None:
        budget = max(least_budget(patterns, w), int(EPOCHS * sum(n for member, n in patterns if any(x in w for x in member))))
    plan = solve(patterns, w, budget, passes)
    spark = docs.sparkSession
    whole = [u // n for u, (_, n) in zip(plan.used, patterns)]
    rest = [u - k * n for u, k, (_, n) in zip(plan.used, whole, patterns)]
    # the bucket in which the rest ends: the first one whose running total reaches it
    side = spark.createDataFrame([(m, int(r)) for (m, _), r in zip(found, rest)], "m string, rest long")
    from pyspark.sql import Window

    running = F.sum("n").over(Window.partitionBy("m").orderBy("b"))  # BUCKETS rows a pattern
    ends = histogram.withColumn("total", running).join(F.broadcast(side), "m").where("total >= rest and total - n < rest").select("m", "b", (F.col("rest") - (F.col("total") - F.col("n"))).alias("left"))
    inside = stored.join(F.broadcast(ends), ["m", "b"]).groupBy("m", "h", "left").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("m").orderBy("h"))  # of one bucket of each pattern
    near = inside.withColumn("total", total).where(F.col("total") - F.col("n") / 2 <= F.col("left"))
    cuts = {r["m"]: r["h"] for r in near.groupBy("m").agg(F.max_by("h", "total").alias("h")).collect()}
    start = {r["m"]: r["b"] for r in ends.collect()}
    rows = []
    for (m, _), k, r in zip(found, whole, rest):
        # hashes are compared as (bucket, value); without an end inside the bucket everything before it counts
        rows.append((m, k, start.get(m, -1) if r > 0 else -1, cuts.get(m) if r > 0 else None))
    whole_name, end_name, cut_name = (free_name(names, x) for x in ("_whole", "_end", "_cut"))
    plan_rows = F.broadcast(spark.createDataFrame(rows, f"`{member}` string, `{whole_name}` int, `{end_name}` int, `{cut_name}` long"))
    b = F.shiftrightunsigned(F.col(order), 54).cast("int")
    extra = (b < F.col(end_name)) | ((b == F.col(end_name)) & F.col(cut_name).isNotNull() & (F.col(order) <= F.col(cut_name)))
    n_copies = F.coalesce(F.col(whole_name) + F.when(extra, 1).otherwise(0), F.lit(1))
    # patterns without tokens aren't in the plan: their rows, all empty, stay once
    empty = F.coalesce(F.col(f"`{text}`"), F.lit("")) == ""
    done = marked.join(plan_rows, member, "left").withColumn(copies, F.when(empty, 1).otherwise(n_copies).cast("int"))
    return done.select(*(F.col(f"`{c}`") for c in names), F.col(copies)), plan


def repeated(mixed: DataFrame, copies: str) -> DataFrame:
    """Each row as often as its plan says, in the columns of the documents."""
    names = [c for c in mixed.columns if c != copies]
    again = F.explode(F.sequence(F.lit(1), F.col(copies)))
    return mixed.where(F.col(copies) > 0).withColumn(copies, again).select(*(F.col(f"`{c}`") for c in names))
