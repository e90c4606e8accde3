"""Rank-order profiles against counting by hand, and their held-out accuracy."""

import zlib
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import rank_order
from shelfmark.llm.common import table
from tests.llm.conftest import COLUMNS, edge_texts

SF_DIR = "/root/testdata/sf0.01"


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    found = Counter()
    for word in words:
        found.update(word)
    shown = " " + " ".join(words) + " " if words else ""
    for n in (2, 3):
        found.update(g for g in (shown[i : i + n] for i in range(len(shown) - n + 1)) if n == 2 or g[1] != " ")
    return found


def ranking(counter, length):
    return [g for g, _ in sorted(counter.items(), key=lambda x: (-x[1], x[0]))[:length]]


def nearest(text, profiles, length):
    mine = ranking(grams(text), length)
    if not mine:
        return "und", 0.0
    far = []
    for lang, profile in profiles.items():
        place = {g: i for i, g in enumerate(profile)}
        far.append((sum(abs(place[g] - i) if g in place else length for i, g in enumerate(mine)), lang))
    far.sort()
    second = far[1][0] if len(far) > 1 else length * len(mine)
    return far[0][1], (second - far[0][0]) / second if second else 0.0


TEXTS = [t or "" for t in edge_texts()] + ["İstanbul ǅ ŉ", "日本語 テキスト 한국어 ελληνικά", "x", "𝒳𝒴 𐐀𐐁", "a\0b"]


@pytest.mark.parametrize("window", [1 << 20, 3, 8])
def test_ngrams_are_those_of_words(monkeypatch, window):
    monkeypatch.setattr(rank_order, "WINDOW", window)
    short = [t[:2000] for t in TEXTS]
    for text, (found, counts) in zip(short, rank_order.ngrams(short), strict=True):
        assert (np.diff(found) > 0).all()
        assert {rank_order.gram_text(int(g)): int(n) for g, n in zip(found, counts)} == dict(grams(text))


def test_many_letters_need_wide_keys():
    text = " ".join(chr(0x4E00 + i) + chr(0x4E00 + 7 * i % 3000) for i in range(3000))
    ((found, counts),) = rank_order.ngrams([text])
    assert {rank_order.gram_text(int(g)): int(n) for g, n in zip(found, counts)} == dict(grams(text))


def test_profiles_and_predictions_equal_those_by_hand(spark, monkeypatch):
    monkeypatch.setattr(rank_order, "HELD", 50)
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    counts = {}
    for r in rows:
        if not held[r.doc_id] and r.lang is not None:
            counts.setdefault(r.lang, Counter()).update(grams(r.text))
    profiles = {lang: ranking(c, 120) for lang, c in counts.items()}
    learned = rank_order.profiles(docs.filter(~rank_order.held_out(4, 2)), 120)
    got = {}
    for r in learned.orderBy("lang", "place").collect():
        got.setdefault(r.lang, []).append(rank_order.gram_text(r.gram))
    assert got == profiles
    whole = rank_order.identify(docs, learned, 120).collect()
    parted = rank_order.identify(docs, learned, 120, group=1).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parted))
    for r in whole:
        text = next(x.text for x in rows if x.doc_id == r.doc_id)
        lang, score = nearest(text, profiles, 120)
        assert (r.held_out, r.lang_pred) == (held[r.doc_id], lang) and r.score == pytest.approx(score)


def test_held_out_accuracy(spark):
    docs = table(spark, SF_DIR, "documents")
    found = rank_order.languages(docs).toPandas().set_index("doc_id")
    lang = docs.select("doc_id", "lang").toPandas().set_index("doc_id").lang
    out = found[found.held_out]
    assert (out.lang_pred == lang[out.index]).mean() > 0.98 and found.score.between(0, 1).all()


def test_held_out_rows_teach_nothing(spark):
    from pyspark.sql import functions as F

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    other = docs.withColumn("lang", F.when(rank_order.held_out(4, 2), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, rank_order.languages(d).collect())) for d in (docs, other))
    assert a == b


def test_edges(spark, edge, nothing):
    found = rank_order.languages(edge).collect()
    assert len(found) == edge.count()
    by_id = {r.doc_id: r for r in found}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (0, 3, 6, 9))
    assert by_id[None].lang_pred == "en" and by_id[None].held_out is False
    assert rank_order.languages(nothing).count() == 0
    unlearned = spark.createDataFrame([(1, "text", None, None, None, None, None, None, None, None, None, None)], COLUMNS)
    assert [(r.lang_pred, r.score) for r in rank_order.languages(unlearned).collect()] == [("und", 0.0)]


def test_tied_languages_give_the_first_by_name(spark):
    rows = [(i, "same text", lang) for i in (1, 2, 3, 4, 5) for lang in ("zz", "aa")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {(r.lang_pred, r.score) for r in rank_order.languages(docs).collect()} == {("aa", 0.0)}


def test_letters_travel_without_the_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    work = "import sys, pickle; f = pickle.load(sys.stdin.buffer); assert f()[97] and not f()[48] and 'shelfmark' not in sys.modules"
    subprocess.run([sys.executable, "-c", work], input=cloudpickle.dumps(rank_order._letters), cwd=tmp_path, check=True)
