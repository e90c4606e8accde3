"""CSV files whose values hold line breaks, read in splits by many tasks.

A split of a text file begins and ends at a line, but that line may stand inside a quoted value. Quotes inside values
are doubled, so a line is inside a value exactly when the quotes before it in its file are odd in number. A first look
at the files gives one row per split: whether its quotes are odd. Their running sum tells how each split begins.
A second look joins lines to records, split by split. The record that is open where a split ends is stitched to the
first lines of the next ones; only such pieces are shuffled.

A quote that is never closed raises. Lines end in LF or CR LF; other files are read with ``multi_line`` given.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators import blocks
from shelfmark.sources.workspace import new_folder

SPLIT = ("file", "start", "length")
WHOLE, OPENS, GOES_ON = 0, 1, 2  # kinds of pieces; the last may also open the next split
PIECES = "split bigint, start bigint, row bigint, kind int, header boolean, record string"
NOT_BLANK = "[^\\x00-\\x20]"


def lines_of(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    place = [F.col(f"_metadata.file_{name}").alias(short) for name, short in zip(("path", "block_start", "block_length"), SPLIT)]
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(*place, F.monotonically_increasing_id().alias("row"), F.col("value"))


def look_through(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A row per split, written down: its number, place, whether it begins and ends inside a value, and holds a line with a break."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    each = lines_of(spark, path).groupBy(*SPLIT).agg(F.sum(quotes % 2).alias("odd"), F.max(quotes % 2).alias("breaks"))
    file = Window.partitionBy("file").orderBy("start")
    so_far = F.sum("odd").over(file) % 2
    last = F.lead("start").over(file).isNull()
    never_closed = F.raise_error(F.concat(F.lit("a quote is never closed in "), "file")).cast("boolean")
    splits = each.select(
        F.monotonically_increasing_id().alias("split"),
        *SPLIT,
        (F.col("breaks") == 1).alias("breaks"),
        ((so_far + F.col("odd")) % 2 == 1).alias("begins_inside"),
        F.when(last & (so_far == 1), never_closed).otherwise(so_far == 1).alias("ends_inside"),
    )
    folder = new_folder(spark, "csv-splits")
    splits.write.parquet(folder)
    return spark.read.schema(splits.schema).parquet(folder)


def has_breaks(splits: DataFrame) -> bool:
    return not splits.where("breaks").isEmpty()


def _in_order(lines: DataFrame, splits: DataFrame, every: bool) -> DataFrame:
    """Lines with their split's number and beginning, as they stand in the split; with ``every`` a line without a split raises.

    Spark may cut the files in another way when the number of cores has changed since they were looked through.
    """
    known = splits.select("split", *SPLIT, "begins_inside")
    few = blocks.fits(known, "split", blocks.SIDE_ROWS)
    joined = lines.join(F.broadcast(known) if few else known, list(SPLIT), "left" if every else "inner")
    if not few:
        joined = joined.sortWithinPartitions("split", "row")
    if every:
        moved = F.raise_error(F.lit("the files were split anew while they were read; read them again")).cast("bigint")
        joined = joined.withColumn("split", F.coalesce("split", moved))
    return joined.select("split", "start", "row", "begins_inside", "value")


class _Split:
    """The lines of one split, joined to records as they come."""

    def __init__(self, split: int, start: int, inside: bool):
        self.split, self.start, self.inside = split, start, inside
        self.goes_on = inside  # the next record began in an earlier split
        self.wants_header = start == 0
        self.held: list[str] = []  # lines of the record that is open
        self.held_row = 0

    def add(self, rows: np.ndarray, lines: pa.StringArray) -> Iterator[pa.RecordBatch]:
        odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) & 1
        after = (np.cumsum(odd) + self.inside) & 1
        self.inside = bool(after[-1])
        closes = np.flatnonzero(after == 0) + 1
        done = int(closes[-1]) if len(closes) else 0
        if done:
            bounds = np.concatenate([[0], closes]).astype(np.int32)
            texts = pc.binary_join(pa.ListArray.from_arrays(bounds, lines.slice(0, done)), "\n")
            first = rows[bounds[:-1]].copy()
            if self.held:
                whole = "\n".join([*self.held, texts[0].as_py()])
                texts = pa.concat_arrays([pa.array([whole], texts.type), texts.slice(1)])
                first[0], self.held = self.held_row, []
            yield self.pieces(first, texts, GOES_ON if self.goes_on else WHOLE)
            self.goes_on = False
        if done < len(lines):
            if not self.held:
                self.held_row = int(rows[done])
            self.held.extend(lines.slice(done).to_pylist())

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            text = pa.array(["\n".join(self.held)], pa.string())
            yield self.pieces(np.array([self.held_row]), text, GOES_ON if self.goes_on else OPENS)

    def pieces(self, rows: np.ndarray, texts: pa.Array, first_kind: int) -> pa.RecordBatch:
        n = len(texts)
        kind, header = np.full(n, WHOLE, np.int32), np.zeros(n, bool)
        kind[0] = first_kind
        for at in range(n if self.wants_header else 0):
            if texts[at].as_py().strip():
                header[at], self.wants_header = True, False
                break
        columns = [np.full(n, self.split), np.full(n, self.start), rows, kind, header]
        names = ["split", "start", "row", "kind", "header", "record"]
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), texts.cast(pa.string())], names=names)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Split | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        split, start, row = (batch.column(at).to_numpy(zero_copy_only=False) for at in range(3))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(split)) + 1, [len(split)]])
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if now is None or now.split != split[low]:
                if now is not None:
                    yield from now.end()
                now = _Split(int(split[low]), int(start[low]), batch.column(3)[low].as_py())
            yield from now.add(row[low:high], batch.column(4).slice(low, high - low))
    if now is not None:
        yield from now.end()


def records(spark: SparkSession, path: str | Sequence[str], splits: DataFrame) -> DataFrame:
    """(file, split, row, record) of every record but the headers; the first three sort as the records stand in the files."""
    lines = lines_of(spark, path)
    pieces = _in_order(lines, splits, every=True).mapInArrow(_pieces, PIECES)
    found = pieces.where(F.col("kind") == WHOLE).drop("kind")
    crossed = splits.where("begins_inside OR ends_inside")
    if not crossed.isEmpty():
        parts = _in_order(lines, crossed, every=False).mapInArrow(_pieces, PIECES).where(F.col("kind") != WHOLE)
        parts = parts.join(splits.select("split", "file"), "split")
        order = Window.partitionBy("file").orderBy("start", "row")
        numbered = parts.withColumn("_nth", F.sum((F.col("kind") == OPENS).cast("int")).over(order))
        stitched = numbered.groupBy("file", "_nth").agg(
            *(F.min_by(name, F.struct("start", "row")).alias(name) for name in ("split", "start", "row")),
            F.max("header").alias("header"),
            F.array_sort(F.collect_list(F.struct("start", "row", "record"))).alias("parts"),
        )
        text = F.array_join("parts.record", "\n").alias("record")
        found = found.unionByName(stitched.select("split", "start", "row", "header", text))
    files = splits.select("split", "file")
    if blocks.fits(files, "split", blocks.SIDE_ROWS):
        files = F.broadcast(files)
    kept = found.where(~F.col("header") & F.col("record").rlike(NOT_BLANK)).join(files, "split")
    return kept.select("file", F.col("start").alias("split"), "row", F.regexp_replace("record", "\\r\\z", "").alias("record"))


def parsed(rows: DataFrame, schema: T.StructType, options: dict) -> DataFrame:
    """(place, fields): the columns of every record as text; a record with too few or too many fields raises."""
    ddl = ", ".join(f"`{field.name}` string" for field in schema)
    use = {name: str(value) for name, value in options.items() if name != "header"}
    place = F.struct("file", "split", "row").alias("place")
    return rows.select(place, F.from_csv("record", ddl, {**use, "multiLine": "true"}).alias("fields"))
