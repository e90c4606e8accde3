"""Near-duplicate documents by BagMinHash: weighted MinHash of shingle multisets, banded and verified.

Each shingle of weight w (how often the text holds it) owns the levels 1 to w. Levels are grouped in octaves (1; 2;
3-4; 5-8; ...). An octave of a shingle is a Poisson process of events, each with a time, a register and a level of the
octave, drawn from hashes of shingle, octave and event number, so they are the same in every text. A register keeps
the earliest event whose level the text's weight reaches. Two texts agree in a register with a probability equal to
their weighted Jaccard similarity. Events later than the text's latest register are never drawn, so the work is about
the number of distinct shingles plus REGISTERS log REGISTERS.

Defined results: a text without words (null, empty, blank) is in no class but its own copies'; rows sharing a doc_id
are one document; a row without doc_id links with nothing and has a null class; an empty table gives no rows; long
texts are hashed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import mix64
from shelfmark.llm.near import bands_of, near_classes
from shelfmark.llm.shingles import shingles

REGISTERS = 128
ROWS = 5  # entries of a band: a pair at 0.8 misses all 25 bands with a probability of 5e-5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """16-bit names of the registers' earliest events, a row per text, and which texts have any."""
    hashes, number = shingles(texts)
    n = len(number)
    owner = np.repeat(np.arange(n), number)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    weight = np.diff(np.append(first, len(hashes)))
    hashes, owner = hashes[first], owner[first]
    octaves = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
    row = np.repeat(np.arange(len(hashes)), octaves)
    octave = np.arange(len(row)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    width = np.where(octave > 0, 1 << np.maximum(octave - 1, 0), 1).astype(np.uint64)
    below = np.where(octave > 0, width.astype(np.int64), 0)
    seed = mix64(hashes[row] + octave.astype(np.uint64) * _STEP)
    doc, limit = owner[row], weight[row]
    time = np.zeros(len(row))
    earliest = np.full(n * REGISTERS, np.inf)
    name = np.zeros(n * REGISTERS, np.uint16)
    event = np.zeros(1, np.uint64)
    while len(row):
        event = event + np.uint64(1)
        draw = mix64(seed + event * _STEP)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (width * REGISTERS)
        draw = mix64(draw)
        level = below + 1 + (((draw >> np.uint64(32)) * width) >> np.uint64(32)).astype(np.int64)
        at = doc * REGISTERS + (draw & np.uint64(REGISTERS - 1)).astype(np.int64)
        valid = level <= limit
        np.minimum.at(earliest, at[valid], time[valid])
        won = valid & (earliest[at] == time)
        name[at[won]] = (mix64(draw[won]) >> np.uint64(48)).astype(np.uint16)
        latest = earliest.reshape(n, REGISTERS).max(axis=1)
        on = np.flatnonzero(time < latest[doc])
        row, seed, doc, limit, time, width, below = (x[on] for x in (row, seed, doc, limit, time, width, below))
    return name.reshape(n, REGISTERS), number > 0


def sign(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and band keys; a text without words has band keys of 0."""
    signature, full = signatures(texts)
    bands = bands_of(signature, ROWS)
    bands[~full] = 0
    return signature, bands


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of its class) and kept of every document; a row each."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    classes = near_classes(docs, sign, multiset=True)
    return ids.join(classes, "doc_id", "left").select(
        "doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept")
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class (the least doc_id, one row of it), with the columns of docs; rows without doc_id stay."""
    best = near_classes(docs, sign, multiset=True).filter("doc_id = class_id").select("doc_id")
    named = docs.filter("doc_id IS NOT NULL").join(best, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))
