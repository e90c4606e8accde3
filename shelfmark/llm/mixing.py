"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A small flow network routes
each pattern's words to the quotas of its sources; a pattern's first, second and third use are parallel edges of
rising cost, so repetition is convex and spread evenly. The flow says how often each pattern is taken; within a
pattern, documents are selected by a seeded hash of id and text. Only the sums per pattern reach the driver.

The rest of a pattern's flow that whole uses leave is filled in two steps. Documents are taken in hash order up to the
first that doesn't fit. The gap left is less than that document's size; it is filled from the counts of the remaining
documents by size, largest fitting size first, so in the end it is smaller than the smallest document left (one more
document follows where that brings the words nearer). Of each size, the first documents in hash order are taken.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a document of size 0
is never taken; rows that share id (or have none) and text are taken one by one like others, and of such a group as
many as it takes; an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import WORD, stored, text_of

MAX_PATTERNS = 100_000  # rows of the flow network on the driver; more is an error, not a cut
ROWS_PER_BIN = 2048  # documents in the one hash bin of a pattern, or of a size, that is looked at row by row
REPEATS = 3
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("bigint")


def capped_targets(sizes: list[int], weights: list[float], most: float = REPEATS) -> list[float]:
    """Shares of the sum of sizes by weight; what exceeds `most` times a size goes to the others by weight."""
    total, open_ = float(sum(sizes)), list(range(len(sizes)))
    targets = [0.0] * len(sizes)
    left = total
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(over)]
    return targets


class Network:
    """A flow network whose flow is raised to the most by blocking flows."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []

    def edge(self, a: int, b: int, most: int) -> int:
        for x, y, c in ((a, b, most), (b, a, 0)):  # the edge back follows
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
        return len(self.to) - 2

    def _levels(self, start: int, end: int) -> list[int]:
        level = [-1] * len(self.out)
        level[start] = 0
        waiting = deque([start])
        while waiting:
            x = waiting.popleft()
            for e in self.out[x]:
                if self.left[e] > 0 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    waiting.append(self.to[e])
        return level

    def raise_flow(self, start: int, end: int) -> None:
        while (level := self._levels(start, end))[end] >= 0:
            at = [0] * len(self.out)
            path: list[int] = []
            x = start
            while True:
                if x == end:
                    amount = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= amount
                        self.left[e ^ 1] += amount
                    full = next(i for i, e in enumerate(path) if not self.left[e])
                    x = self.to[path[full] ^ 1]
                    del path[full:]
                    continue
                while at[x] < len(self.out[x]):
                    e = self.out[x][at[x]]
                    if self.left[e] > 0 and level[self.to[e]] == level[x] + 1:
                        break
                    at[x] += 1
                else:
                    if x == start:
                        break
                    x = self.to[path.pop() ^ 1]
                    at[x] += 1
                    continue
                path.append(e)
                x = self.to[e]


def route(capacity: list[tuple[tuple[int, ...], int]], quota: list[int], repeats: int = REPEATS) -> list[dict[int, int]]:
    """Words that flow from each pattern to each of its sources, at least repetition cost.

    capacity: (sources of a pattern, its words). The k-th use of a pattern costs k - 1 a word. Costs lie only on the
    edges out of the start, so cheapest paths are those over the earliest use that is still open: the most flow with
    first uses, raised with second ones, and so on, is the cheapest.
    """
    n = len(capacity)
    start, end = n + len(quota), n + len(quota) + 1
    net = Network(end + 1)
    uses = [net.edge(start, p, 0) for p in range(n)]
    flows = [[(s, net.edge(p, n + s, repeats * words)) for s in members] for p, (members, words) in enumerate(capacity)]
    for s, most in enumerate(quota):
        net.edge(n + s, end, most)
    for _ in range(repeats):
        for p, (_, words) in enumerate(capacity):
            net.left[uses[p]] += words
        net.raise_flow(start, end)
    return [{s: net.left[e ^ 1] for s, e in some if net.left[e ^ 1]} for some in flows]


def plan_mix(sized: DataFrame, weights: tuple[float, ...], repeats: int = REPEATS) -> DataFrame:
    """Per membership pattern: its words, the words the mix takes from it, and each source's words and target.

    sized: columns members (sorted array of source names), size. Weights repeat over the sources in code point order,
    null last. A document in several sources counts in the size of each.
    """
    spark = sized.sparkSession
    rows = sized.groupBy("members").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("documents")).take(MAX_PATTERNS + 1)
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    names = sorted({m for r in rows for m in r.members}, key=lambda m: (m is None, (m or "").encode()))
    at = {m: i for i, m in enumerate(names)}
    patterns = [(tuple(at[m] for m in r.members), int(r.words)) for r in rows]
    sizes = [0] * len(names)
    for members, words in patterns:
        for s in members:
            sizes[s] += words
    weight = [weights[i % len(weights)] for i in range(len(names))]
    # Words are shared out once each, however many sources they belong to.
    unique = sum(words for _, words in patterns)
    scale = unique / max(1, sum(sizes))
    targets = [t * scale for t in capped_targets(sizes, weight, repeats)] if scale < 1 else capped_targets(sizes, weight, repeats)
    quota = [min(round(t), repeats * size) for t, size in zip(targets, sizes, strict=True)]
    flows = route(patterns, quota, repeats)
    plan = [
        (list(r.members), words, int(r.documents), sum(flow.values()), [(names[s], sizes[s], targets[s]) for s in members])
        for r, (members, words), flow in zip(rows, patterns, flows, strict=True)
    ]
    kind = (
        "members array<string>, words bigint, documents bigint, taken_words bigint,"
        " quotas array<struct<source:string,source_size:bigint,target:double>>"
    )
    return spark.createDataFrame(plan, kind)


def hashed(seed: int) -> Column:
    """A seeded hash of a row's id and text as a number below 2^62."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", text_of(), F.lit(seed)), 2)


def _of(*names: str) -> Column:
    """Whether the keys of two tables are equal, nulls too: m_<name> on the right."""
    both = [F.col(n).eqNullSafe(F.col(f"m_{n}")) for n in names]
    return both[0] if len(both) == 1 else both[0] & both[1]


def _first_by_hash(rows: DataFrame, budget: DataFrame, *keys: str) -> DataFrame:
    """Per key: the hash below which rows are taken, the words that they have, and the size of the first that is not.

    rows: keys, hash, size; budget: keys, rest, documents. Rows are taken whole in hash order as long as their words
    do not exceed the rest; rows of one hash together. Hash bins are summed first, only the bin in which the rest ends
    is read row by row.
    """
    bins = F.greatest(F.lit(1), F.expr(f"documents DIV {ROWS_PER_BIN}")).cast("bigint")
    known = budget.select(*[F.col(k).alias(f"m_{k}") for k in keys], "rest", bins.alias("bins"))
    at = F.floor(F.col("hash") / F.lit(float(1 << 62)) * F.col("bins")).cast("bigint")
    binned = rows.join(F.broadcast(known), _of(*keys)).withColumn("bin", at).select(*keys, "rest", "bin", "hash", "size")
    order = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = binned.groupBy(*keys, "rest", "bin").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    last = sums.filter("before <= rest AND rest < before + words").groupBy(*keys).agg(F.min(F.struct("bin", "before")).alias("x"))
    last = last.select(*[F.col(k).alias(f"m_{k}") for k in keys], F.col("x.bin").alias("last_bin"), F.col("x.before").alias("before"))
    near = binned.join(F.broadcast(last), _of(*keys) & (F.col("bin") == F.col("last_bin")))
    entries = near.groupBy(*keys, "rest", "before", "hash").agg(F.sum("size").alias("words"))
    order = Window.partitionBy(*keys).orderBy("hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = entries.withColumn("upto", F.col("before") + F.sum("words").over(order)).filter("upto > rest")
    first = run.groupBy(*keys).agg(F.min(F.struct("hash", (F.col("upto") - F.col("words")).alias("taken"), "words")).alias("x"))
    return first.select(*keys, F.col("x.hash").alias("below"), F.col("x.taken").alias("taken"))


def _fill(sizes: list[tuple[int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(size, how many, of how many) that fill the gap, largest fitting size first; sizes: (size, documents).

    In the end the gap is below the smallest size left, or is overstepped by it if that is nearer.
    """
    out, first_left = {}, None
    for size, number in sorted(sizes, reverse=True):
        use = min(number, gap // size)
        gap -= use * size
        if use:
            out[size] = [use, number]
        if use < number:
            first_left = size
    if first_left is not None and first_left - gap < gap:
        number = dict(sizes)[first_left]
        out.setdefault(first_left, [0, number])[0] += 1
    return [(size, use, number) for size, (use, number) in out.items()]


def choose(sized: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is taken once more than a pattern's full uses, so that the words taken come nearest the flow.

    Gives per pattern: uses, quotas and the hash below which all are taken; per pattern and size: the hash below which
    those of that size are taken; per hash: of rows that are alike, how many are taken (ties).
    """
    plan = plan.withColumn("uses", F.expr("IF(words > 0, taken_words DIV words, 0)")).withColumn("rest", F.expr("taken_words - uses * words"))
    rows = sized.filter("size > 0").select("members", "hash", "size")
    budget = plan.filter("rest > 0")
    first = stored(_first_by_hash(rows, budget.select("members", "rest", "documents"), "members"), "mix-first")
    left = first.join(plan.select(F.col("members").alias("m_members"), "rest"), _of("members")).select(
        F.col("members").alias("m_members"), "below", (F.col("rest") - F.col("taken")).alias("gap")
    )
    # every size that a gap can take is below the size of one document, and sizes that fit twice become ever fewer
    counted = (
        rows.join(F.broadcast(left), _of("members"))
        .filter("hash >= below AND size < 2 * gap")
        .groupBy("members", "gap", "size")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def fill(pdf):
        import pandas as pd

        members = pdf["members"].iloc[0]
        found = _fill(list(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True)), int(pdf["gap"].iloc[0]))
        rows = [(members, size, size * use, number) for size, use, number in found]
        return pd.DataFrame(rows, columns=["members", "size", "rest", "documents"])

    kind = "members array<string>, size bigint, rest bigint, documents bigint"
    fills = stored(counted.withColumn("pattern", F.to_json(F.struct("members"))).groupBy("pattern").applyInPandas(fill, kind), "mix-fills")
    beyond = rows.join(F.broadcast(left.drop("gap")), _of("members")).filter("hash >= below").select("members", "hash", "size")
    cuts = _first_by_hash(beyond, fills, "members", "size")
    named = fills.select(F.col("members").alias("m_members"), F.col("size").alias("m_size"), "rest")
    # without a cut all documents of that size are taken
    cut = named.join(
        cuts.select(F.col("members").alias("c_members"), F.col("size").alias("c_size"), F.col("below").alias("also_below"), "taken"),
        F.col("m_members").eqNullSafe(F.col("c_members")) & (F.col("m_size") == F.col("c_size")),
        "left",
    )
    cut = stored(
        cut.select(
            "m_members", "m_size", F.coalesce("also_below", F.lit(1 << 62)).alias("also_below"),
            F.expr("coalesce((rest - taken) DIV m_size, 0)").alias("alike"),
        ),
        "mix-cuts",
    )
    whole = plan.select(F.col("members").alias("m_members"), "uses", "quotas").join(
        first.select(F.col("members").alias("c_members"), "below"), F.col("m_members").eqNullSafe(F.col("c_members")), "left"
    )
    whole = whole.select("m_members", "uses", "quotas", F.coalesce("below", F.lit(0).cast("bigint")).alias("below"))
    ties = cut.filter("alike > 0").select(F.col("m_members"), F.col("also_below").alias("m_hash"), "alike")
    return whole, cut.drop("alike"), ties


def _taken(rows: DataFrame, sized: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """rows (members, hash, size and others) with quotas and copies: how often each row is taken."""
    whole, cut, ties = choose(sized, plan_mix(sized, weights))
    cut = cut.withColumnsRenamed({"m_members": "c_members"})
    ruled = rows.join(F.broadcast(whole), _of("members")).drop("m_members")
    ruled = ruled.join(F.broadcast(cut), F.col("members").eqNullSafe(F.col("c_members")) & (F.col("size") == F.col("m_size")), "left")
    more = (F.col("hash") < F.col("below")) | ((F.col("hash") >= F.col("below")) & (F.col("hash") < F.col("also_below")))
    copies = F.when(F.col("size") > 0, F.col("uses") + F.when(more, 1).otherwise(0)).otherwise(0).cast("bigint")
    ruled = ruled.withColumn("copies", copies).drop("uses", "below", "also_below", "m_size", "c_members")
    if ties.isEmpty():
        return ruled
    # of rows that share a hash some are taken: alike rows become one with their number, and the first ones are taken
    names = [c for c in ruled.columns if c != "copies"]
    marked = ruled.join(F.broadcast(ties), _of("members") & (F.col("hash") == F.col("m_hash")), "left")
    alone = marked.filter("alike IS NULL").select(*ruled.columns)
    groups = marked.filter("alike IS NOT NULL").groupBy(*names, "copies", "alike").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("members", "hash").orderBy(*[F.to_json(F.struct(F.col(c))) for c in names]).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("more", F.greatest(F.lit(0), F.col("alike") - F.coalesce(F.sum("n").over(order), F.lit(0))))
    each = groups.withColumn("at", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    each = each.withColumn("copies", F.col("copies") + F.when(F.col("at") <= F.col("more"), 1).otherwise(0))
    return alone.unionByName(each.select(*ruled.columns))


def sized_rows(docs: DataFrame, members: Column, seed: int, *keep: str) -> DataFrame:
    return docs.select(*keep, members.alias("members"), hashed(seed).alias("hash"), word_count(text_of()).alias("size"))


def mix(docs: DataFrame, members: Column, weights: tuple[float, ...] = WEIGHTS, seed: int = 20) -> DataFrame:
    """Per row: doc_id, size, taken (words, repeats counted) and quotas (source, its size and target), narrow.

    members: sorted array of the names of the sources a row belongs to.
    """
    sized = stored(sized_rows(docs, members, seed, "doc_id"), "mix-sizes")
    taken = (F.col("size") * F.col("copies")).cast("bigint")
    return _taken(sized, sized, weights).select("doc_id", "size", taken.alias("taken"), "quotas")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 20) -> DataFrame:
    """The mix of whole documents by their column source: each row as often as it is taken, with the columns of docs."""
    sized = stored(sized_rows(docs, F.array("source"), seed), "mix-sizes")
    rows = docs.select(F.struct("*").alias("row"), F.array("source").alias("members"), hashed(seed).alias("hash"), word_count(text_of()).alias("size"))
    taken = _taken(rows, sized, weights).filter("copies > 0").select("row", "copies")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("row.*")
