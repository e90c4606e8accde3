"""Array arithmetic of one nearest-neighbour block, run inside Spark tasks.

Costs are "smaller is better": squared L2, or the negated inner product. A
float32 matrix product bounds every pair's cost; only pairs that can still be
among the best k are computed again, in float64 and in a fixed order, so equal
vectors get equal costs wherever they are stored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

PAIRS_AT_ONCE = 4_000_000
FIRST_TILE = 2048  # items that give queries without a bound their first one; more where k is large
TILE_CELLS = 1 << 18  # pairs of a tile: what is written fits into a core's own cache
TILE_QUERIES = 512
TILE_HITS = 1 << 18  # results of the queries of a tile
GROUP = 16  # items of a tile that are passed over together, by the least of their rough costs
CELLS_AT_ONCE = 1 << 16
FLOAT32_STEP = 6e-8
SETTLED_AT_ONCE = 1 << 19  # pairs of the queries that are settled together
LONG_ROWS = 256  # pairs per query from which on parting them is faster than sorting all

Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def smallest(cost: np.ndarray, item: np.ndarray, k: int) -> np.ndarray:
    """Places of the k cheapest, ties by item, in no order."""
    last = np.partition(cost, k - 1)[k - 1]
    below = np.flatnonzero(cost < last)
    same = np.flatnonzero(cost == last)
    room = k - len(below)
    if len(same) > room:
        same = same[np.argpartition(item[same], room - 1)[:room]]
    return np.concatenate([below, same])


class BestPairs:
    """The k cheapest (cost, item) pairs seen so far, per query.

    ``bound`` is a cost above which a pair cannot be among the k cheapest. ``repeated``: an item may come in twice, as
    when items are stored in several cells.

    What is kept lies in portions of neighbouring queries. Settling goes through them one by one, so that besides the
    kept pairs and the offered ones, about a quarter as many, only a portion is in memory.
    """

    def __init__(self, queries: int, k: int, bound: np.ndarray | None = None, repeated: bool = True):
        self.k = k
        self.repeated = repeated
        self.bound = np.full(queries, np.inf) if bound is None else bound.copy()
        self.room = max(queries * k // 4, 1_000_000)
        self.width = max(1, SETTLED_AT_ONCE // k)  # queries of a portion
        self.kept: list[Pairs | None] = [None] * -(-queries // self.width)
        self.parts: list[Pairs] = []
        self.waiting = 0

    def offer(self, query: np.ndarray, item: np.ndarray, cost: np.ndarray) -> None:
        if not len(query):
            return
        self.parts.append((query.astype(np.int32), item, cost))
        self.waiting += len(query)
        open_ended = self.waiting >= len(self.bound) * self.k and np.isinf(self.bound).any()
        if open_ended or self.waiting > self.room:
            self._settle()

    def _by_query(self, query: np.ndarray) -> np.ndarray:
        if len(self.bound) <= 1 << 16:  # 16-bit keys are sorted by radix
            return np.argsort(query.astype(np.uint16), kind="stable")
        return np.argsort(query, kind="stable")

    def _settle(self) -> None:
        query = np.concatenate([part[0] for part in self.parts])
        order = self._by_query(query).astype(np.int32)
        query = query[order]
        item, cost = (np.concatenate([part[at] for part in self.parts])[order] for at in (1, 2))
        self.parts, self.waiting = [], 0
        del order
        ends = np.searchsorted(query, np.arange(1, len(self.kept) + 1) * self.width)
        for at, (low, high) in enumerate(zip(np.append(0, ends[:-1]), ends)):
            if low == high:
                continue
            some = query[low:high], item[low:high], cost[low:high]
            before = self.kept[at]
            if before is not None:
                some = tuple(np.concatenate(column) for column in zip(before, some))
            if not self.repeated and len(some[0]) >= LONG_ROWS * min(self.width, len(self.bound)):
                self.kept[at] = self._cut(*some)
            else:
                self.kept[at] = self._sort(*some)

    def _cut(self, query: np.ndarray, item: np.ndarray, cost: np.ndarray) -> Pairs:
        """With many pairs per query, each query's are parted at the k-th; nothing is sorted."""
        order = self._by_query(query)
        query, item, cost = query[order], item[order], cost[order]
        names, begins = np.unique(query, return_index=True)
        kept = []
        for name, begin, end in zip(names, begins, np.append(begins[1:], len(query))):
            if end - begin < self.k:
                kept.append(np.arange(begin, end))
                continue
            some = cost[begin:end]
            chosen = smallest(some, item[begin:end], self.k) if end - begin > self.k else np.arange(self.k)
            self.bound[name] = some[chosen].max()
            kept.append(chosen + begin)
        kept = np.concatenate(kept)
        return query[kept], item[kept], cost[kept]

    def _sort(self, query: np.ndarray, item: np.ndarray, cost: np.ndarray) -> Pairs:
        order = np.lexsort((item, cost))
        order = order[self._by_query(query[order])]
        query, item, cost = query[order], item[order], cost[order]
        if self.repeated:
            fresh = np.ones(len(query), dtype=bool)
            fresh[1:] = (query[1:] != query[:-1]) | (item[1:] != item[:-1])
            query, item, cost = query[fresh], item[fresh], cost[fresh]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        last = nth == self.k - 1
        self.bound[query[last]] = cost[last]
        kept = nth < self.k
        return query[kept], item[kept], cost[kept]

    def portions(self) -> Iterator[Pairs]:
        """(query, item, cost) of the best, some queries at a time; the rows of a query follow each other."""
        if self.waiting:
            self._settle()
        yield from (some for some in self.kept if some is not None)

    def result(self) -> Pairs:
        """All portions together."""
        found = list(self.portions())
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        query, item, cost = (np.concatenate(column) for column in zip(*found))
        return query.astype(np.int64), item, cost


def squared_norms(matrix: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", matrix, matrix, dtype=np.float64)


class Items:
    """Vectors made ready for the scans of many queries; they may come in pieces, which are dropped as they are read."""

    def __init__(self, pieces: np.ndarray | Iterable[np.ndarray], metric: str, rows: int | None = None):
        if isinstance(pieces, np.ndarray):
            pieces, rows = [pieces], len(pieces)
        self.rows, self.dim, self.most, self.tall = rows, 0, 0.0, np.empty((0, 0), np.float32)
        low = 0
        for piece in pieces:
            if low == 0:
                self.dim = piece.shape[1]
                # the last column: for the cost without the query's own part, which is the same for all items
                self.tall = np.empty((rows, self.dim + (metric != "ip")), np.float32)
            norms = squared_norms(piece)
            part = self.tall[low : low + len(piece)]
            part[:, : self.dim] = piece
            part[:, self.dim :] = norms[:, None]
            self.most = np.maximum(self.most, norms.max(initial=0))
            low += len(piece)

    def __len__(self) -> int:
        return self.rows

    def take(self, rows: np.ndarray) -> np.ndarray:
        return self.tall[rows, : self.dim]


def exact_costs(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    """Cost of row i of ``left`` against row i of ``right``."""
    left = left.astype(np.float64)
    if metric == "ip":
        return -np.einsum("ij,ij->i", left, right.astype(np.float64))
    left -= right
    return np.einsum("ij,ij->i", left, left)


class Everything:
    """A rule for pairs that lets some of them pass; this one lets all pass.

    ``dense`` answers for all pairs of some rows and a range of items, ``pairs`` for single ones, which are few.
    """

    def rows(self, rows: np.ndarray) -> np.ndarray:
        """The rows that may find an item of this block; others are left out."""
        return rows

    def dense(self, rows: np.ndarray, low: int, high: int) -> np.ndarray:
        return np.ones((len(rows), high - low), dtype=bool)

    def pairs(self, rows: np.ndarray, items: np.ndarray) -> np.ndarray:
        return np.ones(len(rows), dtype=bool)


class _Hits:
    """Pairs of some queries with the items of a block that may be among the best, by their rough costs."""

    def __init__(self, queries: int):
        self.queries = queries
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pairs = 0

    def add(self, query: np.ndarray, item: np.ndarray, rough: np.ndarray) -> None:
        if len(query):
            self.parts.append((query, item, rough))
            self.pairs += len(query)

    def cut(self, limit: np.ndarray) -> Pairs:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        query, item, rough = (np.concatenate(column) for column in zip(*self.parts))
        near = rough <= limit[query]
        query, item, rough = query[near], item[near], rough[near]
        self.parts, self.pairs = [(query, item, rough)], len(query)
        return query, item, rough

    def kth(self, limit: np.ndarray, k: int) -> np.ndarray:
        """The k-th rough cost of each query, infinite where it has fewer."""
        query, _, rough = self.cut(limit)
        # a number per pair that sorts by query, then by rough cost
        bits = rough.view(np.uint32)
        bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
        keys = (query.astype(np.uint64) << np.uint64(32)) | bits
        keys.sort()
        begins = np.searchsorted(keys, np.arange(self.queries + 1, dtype=np.uint64) << np.uint64(32))
        out = np.full(self.queries, np.inf)
        many = np.flatnonzero(np.diff(begins) >= k)
        bits = (keys[begins[many] + k - 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out[many] = np.where(bits >> 31, bits & np.uint32(0x7FFFFFFF), ~bits).astype(np.uint32).view(np.float32)
        return out


def _places(flags: np.ndarray) -> np.ndarray:
    """Where the flags are set; they are few, so eight are looked at together."""
    if len(flags) % 8:
        return np.flatnonzero(flags)
    eights = np.flatnonzero(flags.view(np.uint64) != 0)
    at, inside = np.nonzero(flags.reshape(-1, 8)[eights])
    return eights[at] * 8 + inside


def _upward(limit: np.ndarray) -> np.ndarray:
    return np.nextafter(limit.astype(np.float32), np.float32(np.inf))


def _near(rough: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items and queries of the rough costs (a row per item, a whole number of groups) up to each query's limit.

    Few are near, so the least cost of a group of items is looked at first; NaN is never near.
    """
    queries = rough.shape[1]
    groups = rough.reshape(-1, GROUP, queries)
    group, query = np.divmod(_places((np.fmin.reduce(groups, axis=1) <= limit).ravel()), queries)
    if len(group) * 12 * GROUP > rough.size:
        return np.divmod(_places((rough <= limit).ravel()), queries)
    at, inside = np.nonzero(groups[group, :, query] <= limit[query][:, None])
    return group[at] * GROUP + inside, query[at]


def scan_block(
    best: BestPairs,
    queries: np.ndarray,
    rows: np.ndarray,
    items: np.ndarray | Items,
    item_ids: np.ndarray,
    metric: str,
    allowed: Everything | None = None,
) -> None:
    """Offer the items that may be near queries ``rows`` to ``best``.

    ``allowed`` says which pairs may be found. Items pass in tiles that stay in the cache: each tile's rough costs are
    one matrix product, and whenever twice as many items have been seen, the k-th rough cost among them lowers what
    passes. Exact costs are for what is left in the end, so the more items come in one call, the better. A rule is asked
    for all pairs only while a query has no such limit yet.
    """
    if allowed is not None:
        rows = allowed.rows(rows)
    if len(items) == 0 or len(rows) == 0:
        return
    if not isinstance(items, Items):
        items = Items(items, metric)
    dim, k, tall, most = queries.shape[1], best.k, items.tall, items.most

    def scan(part: np.ndarray, first: int, tile: int, space: np.ndarray) -> None:
        block = queries[part]
        norms = squared_norms(block)
        if metric == "ip":
            wide, own = -block.T, np.zeros(len(part))
        else:
            wide = np.concatenate([block * np.float32(-2), np.ones((len(part), 1), np.float32)], axis=1).T
            own = norms
        slack = (2 * dim + 16) * FLOAT32_STEP * (norms + most)
        limit = _upward(best.bound[part] - own + slack)
        hits, lower_at = _Hits(len(part)), first

        def lowered() -> np.ndarray:
            if hits.pairs * 4 < len(part) * k:  # hardly a query has k of them
                return limit
            return np.minimum(limit, _upward(hits.kth(limit, k) + 2 * slack))

        low = 0
        while low < len(items):
            high = min(low + (tile if low else first), len(items))
            tall_rows = -(-(high - low) // GROUP) * GROUP
            rough = space[: tall_rows * len(part)].reshape(tall_rows, len(part))
            np.matmul(tall[low:high], wide, out=rough[: high - low])
            rough[high - low :] = np.nan
            blind = np.flatnonzero(np.isinf(limit))
            if allowed is not None and len(blind):
                mask = allowed.dense(part[blind], low, high).T
                rough[: high - low, blind] = np.where(mask, rough[: high - low, blind], np.nan)
            if low == 0 and k < high and len(blind):  # those with a limit may hold pairs that the rule forbids
                # multiplied anew, which is faster than to turn the tile
                turned = wide.T[blind] @ tall[:high].T if allowed is None else rough[:high].T[blind]
                turned.partition(k - 1, axis=1)
                nearest = turned[:, k - 1]
                nearest = np.where(np.isnan(nearest), np.inf, nearest)
                limit[blind] = _upward(nearest.astype(np.float64) + 2 * slack[blind])
            item, query = _near(rough, limit)
            found = rough[item, query]
            item += low
            if allowed is not None and len(blind) < len(part):  # the others' pairs are few
                good = np.zeros(len(part), dtype=bool)
                good[blind] = True
                good = good[query]
                others = np.flatnonzero(~good)
                good[others] = allowed.pairs(part[query[others]], item[others])
                query, item, found = query[good], item[good], found[good]
            hits.add(query, item, found)
            if high >= 2 * lower_at and high < len(items):
                lower_at, limit = high, lowered()
            low = high
        if len(items) > first:
            limit = lowered()
        query, item, _ = hits.cut(limit)
        pairs = max(1, CELLS_AT_ONCE // dim)  # a portion that stays in the cache
        costs = []
        for low in range(0, len(query), pairs):
            q, x = query[low : low + pairs], item[low : low + pairs]
            costs.append(exact_costs(block[q], items.take(x), metric))
        if costs:
            cost, whose = np.concatenate(costs), part[query]
            near = cost <= best.bound[whose]
            best.offer(whose[near], item_ids[item[near]], cost[near])

    blind = np.isinf(best.bound[rows])
    for some, bounded in ((rows[blind], False), (rows[~blind], True)):
        step = max(64, min(TILE_QUERIES, TILE_HITS // k, len(some)))
        first = tile = TILE_CELLS // step
        if not bounded and k * 32 > len(items):  # very many results of a block are parted at once
            first = len(items)
            step = max(1, min(step, PAIRS_AT_ONCE // first))
        elif not bounded:
            first = max(FIRST_TILE, 4 * k, tile)
        space = np.empty((min(max(first, tile), len(items)) + GROUP) * min(step, len(some)), np.float32)
        for start in range(0, len(some), step):
            scan(some[start : start + step], first, tile, space)
