"""Near-duplicate vectors by an exact metric range join.

Unit vectors at a cosine of 0.98 or more lie within a fixed Euclidean distance of each other. Equal vectors of a
label are one class from the start. Seeded pivots of each label part its classes into cells (the nearest pivot). A
class is also copied to every other cell that could hold a neighbour: by the triangle inequality its distance to that
cell's pivot exceeds the one to its own by at most twice the range, and the plane between both pivots is within the
range (the tighter of the two bounds). So all neighbours of a class are in its own cell's data, and cells are joined
independently, by matrix products; pairs next to the threshold are decided anew from the raw components in double
precision. Large cells are cut into slices, joined pair by pair.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without label or
vec_id, link with nothing and are their own component; vectors of different length aren't compared; rows that share
a vec_id and differ are vectors of their own with that id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import stored
from shelfmark.llm.components import components

COSINE = 0.98
CELL = 2048  # classes for which a label gets a further pivot
MOST_PIVOTS = 1024  # of one label
ALL_PIVOTS = 16_384  # of all labels; they travel with the job
SLICE = 8192
SLACK = 1e-9  # of squared distances; well above their rounding errors, which a bound that goes to 0 wouldn't cover
SAME = 1e-5  # pivots nearer than this are one
EDGE = 1e-9  # cosines this near the threshold are computed again


def classes_of_equal(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, key; no key: links with nothing), and classes (key, grp, place, vec, least, n)."""
    element = vectors.schema["embedding"].dataType.elementType.typeName()
    kind = np.float32 if element == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(2):
                values = v.values
                if values is None or len(values) == 0 or values.null_count:
                    out.append(None)
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(kind)
                x = np.where(x == 0, 0, x)  # one zero
                good = np.isfinite(x).all() and np.any(x.astype(np.float64) != 0)
                out.append(x.astype(np.float64).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["vec_id", "label", "vec"]
            )

    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    known = F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    named = rows.mapInArrow(run, "vec_id bigint, label string, vec binary").select(
        "vec_id",
        F.when(known, F.concat_ws(":", F.length("vec").cast("string"), "label")).alias("grp"),
        "vec",
    )
    named = named.withColumn("key", F.when(F.col("grp").isNotNull(), F.md5(F.concat(F.col("grp").cast("binary"), F.lit(b"\0"), F.col("vec")))))
    named = stored(named, "vectors")
    classes = (
        named.filter("key IS NOT NULL")
        .groupBy("key", "grp", "vec")
        .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
        .withColumn("place", F.shiftrightunsigned(F.xxhash64("key", F.lit(10)), 2))
    )
    return named.select("vec_id", "key"), stored(classes, "vector-classes")


def choose_pivots(classes: DataFrame) -> dict[str, np.ndarray]:
    """Unit vectors of the pivots of every label group that is large enough to be parted."""
    sizes = classes.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    scale = min(1.0 / CELL, ALL_PIVOTS / max(1, total))
    wanted = F.least(F.lit(MOST_PIVOTS), F.floor(F.col("n") * scale))
    large = sizes.withColumn("wanted", wanted).filter("wanted >= 2").select("grp", (F.col("wanted") / F.col("n")).alias("share"))
    # At most ALL_PIVOTS / 2 groups, and about ALL_PIVOTS rows.
    found = (
        classes.join(F.broadcast(large), "grp")
        .filter(F.col("place") / F.lit(float(1 << 62)) < F.col("share"))
        .select("grp", "key", "vec")
        .collect()
    )
    out: dict[str, list] = {}
    for r in sorted(found, key=lambda r: r["key"]):
        out.setdefault(r["grp"], []).append(np.frombuffer(r["vec"]))
    apart = {g: directions(unit(np.array(v))) for g, v in out.items()}
    return {g: v for g, v in apart.items() if len(v) >= 2}


def directions(pivots: np.ndarray) -> np.ndarray:
    """Pivots without those that lie at an earlier one: they would share all that is near and split nothing."""
    near = 2 - 2 * (pivots @ pivots.T) < SAME**2
    kept: list[int] = []
    for i in range(len(pivots)):
        if not near[i, kept].any():
            kept.append(i)
    return pivots[kept]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells_of(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector's own cell, and a matrix of the cells that need a copy of it (its own among them)."""
    cosine = x @ pivots.T
    distance = np.sqrt(np.maximum(0, 2 - 2 * cosine))
    home = distance.argmin(axis=1)
    own = distance[np.arange(len(x)), home]
    by_triangle = distance <= own[:, None] + 2 * reach
    between = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)) + SLACK)[home]
    # Distance to the plane between the own pivot and the other one, times twice the distance between both: pivots of
    # one direction have no plane, so what lies at both is copied.
    by_plane = distance**2 - own[:, None] ** 2 <= 2 * reach * between + SLACK
    near = by_triangle & by_plane
    near[np.arange(len(x)), home] = True
    return home, near


def parted(classes: DataFrame, pivots: dict[str, np.ndarray], cosine: float) -> DataFrame:
    """A row for every class and cell that holds it: grp, cell, home (whether the cell is its own), key, n, vec."""
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.array(batch.column(1).to_pylist(), object)
            take, cell, home = [], [], []
            for g in set(groups.tolist()):
                at = np.flatnonzero(groups == g)
                if g not in pivots:
                    take.append(at)
                    cell.append(np.zeros(len(at), np.int64))
                    home.append(np.ones(len(at), bool))
                    continue
                x = unit(np.array([np.frombuffer(batch.column(2)[int(i)].as_buffer()) for i in at]))
                own, near = cells_of(x, pivots[g], reach)
                i, c = np.nonzero(near)
                take.append(at[i])
                cell.append(c)
                home.append(own[i] == c)
            if not take:
                continue
            rows = batch.take(pa.array(np.concatenate(take)))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(np.concatenate(cell), pa.int64()), pa.array(np.concatenate(home))],
                names=["key", "grp", "vec", "n", "cell", "home"],
            )

    return classes.select("key", "grp", "vec", "n").mapInArrow(
        run, "key string, grp string, vec binary, n bigint, cell bigint, home boolean"
    )


def sliced(dealt: DataFrame) -> DataFrame:
    """Rows of `parted` with i and j: the slices of a cell that are joined in one task, and x, y: in which role."""
    large = (
        dealt.groupBy("grp", "cell")
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > SLICE)
        .select("grp", "cell", F.ceil(F.col("rows") / SLICE).cast("int").alias("slices"))
    )
    rows = dealt.join(large, ["grp", "cell"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("key"), F.col("slices")).cast("int")
    every = F.sequence(F.lit(0), F.col("slices") - 1)
    as_y = F.transform(every, lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))
    as_x = F.when(F.col("home"), F.transform(every, lambda j: F.struct(F.col("own").alias("i"), j.alias("j")))).otherwise(
        F.array().cast("array<struct<i:int,j:int>>")
    )
    return (
        rows.withColumn("own", own)
        .withColumn("at", F.explode(F.array_union(as_x, as_y)))
        .withColumn("x", F.col("home") & (F.col("at.i") == F.col("own")))
        .withColumn("y", F.col("at.j") == F.col("own"))
        .select("grp", "cell", "at.i", "at.j", "key", "n", "vec", "x", "y")
    )


def linked(table: pa.Table, cosine: float = COSINE) -> pa.Table:
    """Links of one slice pair: per class the vectors it links with, and edges that join what its links join."""
    keys, n = np.array(table["key"].to_pylist(), object), table["n"].to_numpy()
    raw = np.array([np.frombuffer(v.as_buffer()) for c in table["vec"].chunks for v in c])
    whole = unit(raw)
    xs, ys = np.flatnonzero(table["x"].to_numpy()), np.flatnonzero(table["y"].to_numpy())
    root = np.arange(len(keys))
    links = np.zeros(len(keys), np.int64)
    for first in range(0, len(xs), 512):
        some = xs[first : first + 512]
        c = whole[some] @ whole[ys].T
        hit = c >= cosine + EDGE
        for a, b in zip(*np.nonzero(np.abs(c - cosine) < EDGE), strict=True):
            u, v = raw[some[a]], raw[ys[b]]
            u, v = u / np.abs(u).max(), v / np.abs(v).max()
            hit[a, b] = np.dot(u, v) / (np.sqrt(np.dot(u, u)) * np.sqrt(np.dot(v, v))) >= cosine
        for a, x in enumerate(some):
            found = ys[hit[a]]
            found = found[found != x]
            if not len(found):
                continue
            links[x] += n[found].sum()
            roots = root[found]
            if (roots != root[x]).any():
                joined = np.unique(np.append(roots, root[x]))
                root[np.isin(root, joined)] = joined[0]
    with_edge = np.flatnonzero(root != np.arange(len(keys)))
    with_links = np.flatnonzero(links)
    at = np.concatenate([with_links, with_edge])
    return pa.table(
        {
            "key": pa.array(keys[at].tolist(), pa.string()),
            "links": pa.array(np.concatenate([links[with_links], np.zeros(len(with_edge), np.int64)])),
            "other": pa.array([None] * len(with_links) + keys[root[with_edge]].tolist(), pa.string()),
        }
    )


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector; vectors: vec_id, embedding, label."""
    rows, classes = classes_of_equal(vectors)
    dealt = stored(parted(classes, choose_pivots(classes), cosine), "cells")

    def run(table: pa.Table) -> pa.Table:
        return linked(table, cosine)

    found = stored(sliced(dealt).groupBy("grp", "cell", "i", "j").applyInArrow(run, "key string, links bigint, other string"), "vector-links")
    roots = components(found.filter("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    placed = (
        classes.select("key", "least", "n")
        .join(links, "key", "left")
        .join(roots.withColumnRenamed("node", "key"), "key", "left")
        .select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "key").alias("root"))
    )
    placed = stored(placed, "vector-roots")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    results = placed.join(least, "root").select("key", "n_links", "component_id")
    component = F.coalesce("component_id", "vec_id")
    return rows.join(results, "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
