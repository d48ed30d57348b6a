"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by pattern (the set of sources that a document belongs to) and by size class. Flow runs
from patterns to the quotas of their sources; a pattern's words cost nothing the first time and more with each
repetition, so repetition is convex and first copies go first. Within a pattern each size class gives the same share
of its words, in the order of a seeded hash of id and text; at most one document of each class lies across the cut,
and those few are taken or left from the largest down so that the pattern's sum comes as near as it can.

The driver gets sums for each (pattern, size class), never rows: ``MAX_PATTERNS`` bounds the patterns and the
sources, and a larger number raises. Documents with an empty array of sources belong to none and are not taken. Rows with a null source form the source that comes last. Null texts have size 0 and are not taken.
Repeated rows are separate documents; where a cut falls among equal rows, it does not matter which of them is taken.
An empty table has no sources and gives no rows. Very long documents count whole; where one lies across a cut, its
pattern misses its words by at most half of it. Columns of any names pass through. Reruns agree.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
#: Copies of a document at most.
COPIES = 2
SEED = 7
#: A cut is looked for in slices of the seeded order, BITS of its bits a step, so that rows met in one window are about
#: 2**-21 of those of a (pattern, size class).
BITS, STEPS = 7, 3
#: Rows of the plan that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST = 50_000
#: Distinct patterns, and distinct sources, that the driver plans for at most; more raise an error.
MAX_PATTERNS = 100_000
WORD = r"[^\x20\x09-\x0D]++"


def size_of(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = COPIES) -> dict[str | None, float]:
    """Each source's words: shares of ``total`` times all words by weight, none above ``most`` times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, out = total * sum(sizes.values()), list(order), {}
    while free:
        share = left / sum(weight[s] for s in free)
        if not (full := [s for s in free if weight[s] * share > most * sizes[s]]):
            return out | {s: weight[s] * share for s in free}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


class _Net:
    """A residual network: arcs k and k ^ 1 are each other's way back."""

    def __init__(self):
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def distances(self, start: int) -> list[float]:
        """Least cost of a path to each node."""
        best, todo, queued = [float("inf")] * len(self.out), deque([start]), {start}
        best[start] = 0
        while todo:
            node = todo.popleft()
            queued.discard(node)
            for k in self.out[node]:
                if self.room[k] and best[node] + self.cost[k] < best[self.to[k]]:
                    best[self.to[k]] = best[node] + self.cost[k]
                    if self.to[k] not in queued:
                        queued.add(self.to[k])
                        todo.append(self.to[k])
        return best

    def push(self, start: int, end: int, best: list[float]) -> bool:
        """A blocking flow over the arcs on cheapest paths, fewest arcs first; whether any was found."""
        on = lambda node, k: self.room[k] and best[node] + self.cost[k] == best[self.to[k]]
        level, todo = {start: 0}, deque([start])
        while todo:
            node = todo.popleft()
            for k in self.out[node]:
                if self.to[k] not in level and on(node, k):
                    level[self.to[k]] = level[node] + 1
                    todo.append(self.to[k])
        if end not in level:
            return False
        at, path, node = [0] * len(self.out), [], start
        while True:
            if node == end:
                room = min(self.room[k] for k in path)
                for k in path:
                    self.room[k] -= room
                    self.room[k ^ 1] += room
                full = next(j for j, k in enumerate(path) if not self.room[k])
                node = self.to[path[full] ^ 1]
                del path[full:]
            elif at[node] < len(self.out[node]):
                k = self.out[node][at[node]]
                if level.get(self.to[k]) == level[node] + 1 and on(node, k):
                    path.append(k)
                    node = self.to[k]
                else:
                    at[node] += 1
            elif path:
                node = self.to[path.pop() ^ 1]
                at[node] += 1
            else:
                return True


def flow(capacity: dict[tuple, int], quota: dict[str | None, int], copies: int = COPIES) -> dict[tuple[tuple, str | None], int]:
    """Min-cost flow: words from each pattern to each of its sources.

    A pattern's k-th copy of its words costs k - 1 a word. Primal-dual: for each distance of the end, and there are few
    as costs are small whole numbers, blocking flows over the arcs on cheapest paths; work grows with the arcs times a
    few phases.
    """
    net = _Net()
    start, end = net.node(), net.node()
    sources = {s: net.node() for s in quota}
    routes = {}
    for pattern, words in capacity.items():
        node = net.node()
        for k in range(copies):
            net.arc(start, node, words, k)
        for s in pattern:
            routes[pattern, s] = net.arc(node, sources[s], copies * words)
    for s, words in quota.items():
        net.arc(sources[s], end, words)
    while (best := net.distances(start))[end] < float("inf"):
        while net.push(start, end, best):
            pass
    return {r: net.room[k ^ 1] for r, k in routes.items() if net.room[k ^ 1]}


@dataclass(frozen=True)
class Plan:
    """What the mix takes. cuts: (pattern, size class, whole copies, slice of the cut, words left there, is the document across the cut taken)."""

    sizes: dict[str | None, int]
    targets: dict[str | None, float]
    routes: dict[tuple[tuple, str | None], int]
    cuts: list[tuple]


@dataclass(frozen=True)
class _Names:
    """Columns that ``mix`` adds to its rows while it works, chosen so that none of the rows' own is hit."""

    size: str
    members: str
    pattern: str
    level: str
    order: str
    slice: str
    whole: str
    rest: str
    across: str
    ahead: str
    words: str

    @classmethod
    def of(cls, rows: DataFrame, size: str, members: str) -> _Names:
        return cls(size, members, *fresh(rows, "pattern_key", "size_level", "seeded_order", "order_slice", "whole_copies", "words_left", "across_cut", "words_ahead", "words_sum"))


def _keyed(df: DataFrame, c: _Names) -> DataFrame:
    """``df`` with the pattern's key, the size class and the seeded order."""
    texts = [F.col(f"`{t}`") for t in ("doc_id", "text_hash") if t in df.columns]
    size = F.col(f"`{c.size}`")
    return (
        df.withColumn(c.pattern, F.to_json(F.struct(F.sort_array(F.array_distinct(F.col(f"`{c.members}`"))).alias("m")), {"ignoreNullFields": "false"}))
        .withColumn(c.level, F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int"))
        .withColumn(c.order, F.xxhash64(F.lit(SEED), *texts, size))
    )


def _slice(c: _Names, steps: int) -> Column:
    """The first ``steps`` times BITS bits of the seeded order."""
    return F.shiftrightunsigned(F.col(c.order), 64 - BITS * steps)


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """``rows`` for a join: broadcast up to MAX_BROADCAST of them."""
    made = spark.createDataFrame(rows, schema)
    return F.broadcast(made) if len(rows) <= MAX_BROADCAST else made


def _near(keyed: DataFrame, cuts: list[tuple], c: _Names, steps: int) -> DataFrame:
    """Rows in the slice of a cut (pattern, level, slice, words left), with the last of these."""
    plan = _table(keyed.sparkSession, cuts, f"{c.pattern} string, {c.level} int, {c.slice} long, {c.rest} double")
    return keyed.withColumn(c.slice, _slice(c, steps)).join(plan, [c.pattern, c.level, c.slice])


def _cut(sums: DataFrame, wanted: list[tuple], c: _Names) -> list[tuple]:
    """(pattern, level, slice, words left in it) where the words summed by slice reach those wanted (pattern, level, words).

    At most 2**BITS rows a (pattern, level) are summed in a window. Where less words are there, the slice is -1.
    """
    want = _table(sums.sparkSession, wanted, f"{c.pattern} string, {c.level} int, {c.rest} double")
    run = Window.partitionBy(c.pattern, c.level).orderBy(c.slice)
    upto = sums.join(want, [c.pattern, c.level]).withColumn(c.ahead, F.sum(c.words).over(run))
    met = upto.where(F.col(c.ahead) >= F.col(c.rest)).groupBy(c.pattern, c.level).agg(F.min_by(F.struct(c.slice, (F.col(c.rest) - F.col(c.ahead) + F.col(c.words)).alias("left")), c.slice).alias("met"))
    found = {(r[0], r[1]): (r["met"][0], r["met"][1]) for r in met.collect()}
    return [(k, lv, *found.get((k, lv), (-1, 0.0))) for k, lv, _ in wanted]


def mix(rows: DataFrame, size: str = "size", members: str = "members", total: float = TOTAL, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, Plan]:
    """``rows`` with a column ``copies`` (0, 1, 2), and the plan.

    rows: any columns, among them the words of each document, an array of its sources, ``doc_id`` and, where there
    is one, ``text_hash`` (the two seed the order); a column ``copies`` of theirs is replaced. The frame is read six
    times: it should be a written table.
    """
    spark, columns = rows.sparkSession, [f"`{x}`" for x in rows.columns if x.lower() != "copies"]
    rows = rows.select(*columns)
    c = _Names.of(rows, size, members)
    keyed = _keyed(rows, c)
    words = F.col(f"`{size}`")
    by = [c.pattern, c.level, c.slice]
    some = keyed.where(words > 0)
    sums = materialize(some.withColumn(c.slice, _slice(c, 1)).groupBy(*by).agg(F.sum(words).alias(c.words), F.first(f"`{members}`").alias("members")), "mix-sums")
    found = sums.groupBy(c.pattern).agg(F.sum(c.words).alias("words"), F.first("members").alias("members")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    key = {r[c.pattern]: tuple(sorted(set(r["members"]), key=lambda s: (s is None, s or ""))) for r in found}
    capacity = {key[r[c.pattern]]: r["words"] for r in found}
    named = keyed.select(F.explode(f"`{members}`").alias("s")).distinct().limit(MAX_PATTERNS + 1).collect()
    if len(named) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sources")
    sizes = dict.fromkeys((r["s"] for r in named), 0)
    for p, n in capacity.items():
        for s in p:
            sizes[s] += n
    goal = targets(sizes, weights, total)
    routes = flow(capacity, {s: round(t) for s, t in goal.items()})
    taken = {p: sum(routes.get((p, s), 0) for s in p) for p in capacity}

    levels = {(r[0], r[1]): r[2] for r in sums.groupBy(c.pattern, c.level).agg(F.sum(c.words)).collect()}
    whole, wanted = {}, []
    for (k, lv), n in sorted(levels.items()):
        whole[k, lv], rest = divmod(taken[key[k]], capacity[key[k]])
        wanted.append((k, lv, float(rest) * n / capacity[key[k]]))
    cuts = _cut(sums, wanted, c)
    for step in range(2, STEPS + 1):
        finer = _near(some, cuts, c, step - 1).withColumn(c.slice, _slice(c, step)).groupBy(*by).agg(F.sum(words).alias(c.words))
        cuts = _cut(finer, [(k, lv, rest) for k, lv, _, rest in cuts], c)
    ahead = Window.partitionBy(c.pattern, c.level).orderBy(c.order).rowsBetween(Window.unboundedPreceding, -1)
    at_cut = lambda df, plan: _near(df, plan, c, STEPS).withColumn(c.ahead, F.coalesce(F.sum(words).over(ahead), F.lit(0)))
    lies = (F.col(c.ahead) < F.col(c.rest)) & (F.col(c.ahead) + words >= F.col(c.rest))
    lying = {(r[0], r[1]): (r[2], r[3]) for r in at_cut(some, cuts).where(lies).select(c.pattern, c.level, c.ahead, words).collect()}
    decided, owed = [], {}
    for k, lv, at, rest in sorted(cuts, key=lambda x: (x[0], -x[1])):
        before, n = lying.get((k, lv), (rest, 0))
        owed[k] = owed.get(k, 0.0) + rest - before
        if across := n > 0 and owed[k] >= n / 2:
            owed[k] -= n
        decided.append((k, lv, int(whole[k, lv]), at, rest, across))

    plan = _table(spark, decided, f"{c.pattern} string, {c.level} int, {c.whole} int, {c.ahead} long, {c.rest} double, {c.across} boolean")
    met = keyed.withColumn(c.slice, _slice(c, STEPS)).join(plan, [c.pattern, c.level], "left")
    before = F.col(c.slice) < F.col(c.ahead)
    away = met.where(~F.col(c.slice).eqNullSafe(F.col(c.ahead)) | (words == 0)).withColumn("copies", F.when(words == 0, 0).otherwise(F.coalesce(F.col(c.whole) + before.cast("int"), F.lit(0))))
    inside = at_cut(some, [(k, lv, at, rest) for k, lv, _, at, rest, _ in decided]).join(_table(spark, [(k, lv, w, x) for k, lv, w, _, _, x in decided], f"{c.pattern} string, {c.level} int, {c.whole} int, {c.across} boolean"), [c.pattern, c.level])
    full = F.col(c.ahead) + words < F.col(c.rest)
    inside = inside.withColumn("copies", F.col(c.whole) + (full | (lies & F.col(c.across))).cast("int"))
    return away.select(*columns, "copies").unionAll(inside.select(*columns, "copies")), Plan(sizes, goal, routes, decided)


def _sized(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "source", size_of().alias("size"), F.array("source").alias("members"), F.xxhash64("text").alias("text_hash"))
    return materialize(rows, "sized")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: what the mix takes of every document."""
    taken, plan = mix(_sized(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    sources = F.broadcast(spark.createDataFrame([(s, n, plan.targets[s]) for s, n in plan.sizes.items()], "name string, source_size long, target double"))
    return taken.join(sources, F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", F.col("copies").cast("int").alias("copies"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: each document as often as the mix takes it. Texts are looked up by (doc_id, source, text hash).

    Rows that are equal in these share what is taken of them, in the order of their other columns.
    """
    taken, _ = mix(_sized(docs))
    key, copies, place, i, source, text_hash, total, rows = fresh(docs, "text_key", "times", "place", "vote_id", "vote_source", "vote_hash", "vote_total", "vote_rows")
    votes = taken.groupBy(F.col("doc_id").alias(i), F.col("source").alias(source), F.col("text_hash").alias(text_hash)).agg(F.sum("copies").alias(total), F.count("*").alias(rows))
    votes = materialize(votes.where(f"{total} > 0"), "votes")
    repeated = materialize(votes.where(f"{rows} > 1"), "repeated")
    columns = [f"`{c}`" for c in docs.columns]
    keyed = docs.withColumn(key, F.xxhash64("text"))

    def met(votes: DataFrame) -> DataFrame:
        return keyed.join(votes, keyed["doc_id"].eqNullSafe(votes[i]) & keyed["source"].eqNullSafe(votes[source]) & (keyed[key] == votes[text_hash]))

    among = Window.partitionBy(i, source, text_hash).orderBy(F.to_json(F.struct(*columns)))
    shared = met(repeated).withColumn(place, F.row_number().over(among))
    once = met(votes.where(f"{rows} = 1")).select(*columns, F.col(total).alias(copies))
    several = shared.select(*columns, (F.floor(F.col(total) / F.col(rows)) + (F.col(place) <= F.col(total) % F.col(rows)).cast("long")).alias(copies))
    return once.unionAll(several).select(*columns, F.explode(F.expr(f"array_repeat(0, cast({copies} as int))"))).select(*columns)
