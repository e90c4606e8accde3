"""Classifiers against direct computation, and their accuracy on rows they didn't learn from."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shelfmark.llm import quality, toxicity
from shelfmark.llm.common import table
from shelfmark.llm.labelled import sample_labels

SF_DIR = "/root/testdata/sf0.01"
LABELS = "doc_id bigint, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def labels(spark, edge):
    rows = [(i * 3, i % 2, int(i % 5 == 0), "not a text") for i in range(20)] + [(None, 1, 1, ""), (3, None, None, ""), (999, 1, 0, "")]
    return spark.createDataFrame(rows, LABELS)


def log_density(x, mean, cov):
    d = x - mean
    return -0.5 * (d @ np.linalg.solve(cov, d) + np.linalg.slogdet(cov)[1])


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(0)
    data = {0: rng.normal(0, 2, (200, 4)), 1: rng.normal(1, 1, (300, 4))}
    model = quality.Discriminant({c: (float(len(x)), x.sum(axis=0), x.T @ x) for c, x in data.items()}, {0: 1.0, 1: 1.0})
    cov = {c: np.cov(x.T, bias=True) for c, x in data.items()}
    pooled = (cov[0] + cov[1]) / 2
    for x in rng.normal(0, 2, (20, 4)):
        part = []
        for c in (0, 1):
            s = (1 - quality.SHRINK_POOLED) * cov[c] + quality.SHRINK_POOLED * pooled
            s = (1 - quality.SHRINK_DIAGONAL) * s + quality.SHRINK_DIAGONAL * np.diag(np.diag(s)) + quality.FLOOR**2 * np.eye(4)
            part.append(log_density(x, data[c].mean(axis=0), s))
        odds = (part[1] - part[0]) / quality.TEMPER + np.log(0.6 / 0.4)
        assert model.scores(x[None])[0] == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-9)


def test_statistics_do_not_depend_on_the_batch(corpus):
    texts = [t for _, t in corpus] + ["", " ", "a", "É!", "x | y | z\n", "SHOUT!! "]
    whole = quality.statistics(pa.array(texts))
    single = np.concatenate([quality.statistics(pa.array([t])) for t in texts])
    assert np.isfinite(whole).all() and np.allclose(whole, single)


def test_sample_is_bounded_and_leaves_the_fold_out(spark):
    rows = [(i, 1 if i % 10 else 0, 0, "") for i in range(5000)]
    chosen, weight = sample_labels(spark.createDataFrame(rows, LABELS), "quality", 4, 2, most=300)
    found = chosen.collect()
    number = Counter(r.label for r in found)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in found)
    assert number[1] < 400 and number[0] < 400 and weight[1] > weight[0]


@pytest.mark.parametrize("run, label, modulus, remainder", [(quality.classify, "quality", 4, 2), (toxicity.classify, "toxic", 5, 0)])
def test_held_out_accuracy(spark, run, label, modulus, remainder):
    labels = table(spark, SF_DIR, "labels")
    found = run(table(spark, SF_DIR, "documents"), labels).toPandas().set_index("doc_id")
    known = labels.toPandas().set_index("doc_id")
    both = found.join(known, how="inner")
    out = both[both.held_out]
    assert (found.held_out == [zlib.crc32(str(i).encode()) % modulus == remainder for i in found.index]).all()
    assert (out.predicted == out[label]).mean() > 0.9
    assert found.score.between(0, 1).all() and len(found) == 1000


def test_labels_are_not_looked_at_for_held_out_rows(spark):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    from pyspark.sql import functions as F

    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    turned = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.classify(docs, turned).collect()}
    assert a == pytest.approx(b)


@pytest.mark.parametrize("run", [quality.classify, toxicity.classify])
def test_edges(run, edge, nothing, labels):
    found = run(edge, labels).collect()
    assert len(found) == edge.count() and all(0 <= r.score <= 1 for r in found)
    scores = {}
    for r in found:
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert len(scores[21]) == 1 and next(iter(scores[0])) == next(iter(scores[3]))
    assert [r.held_out for r in found if r.doc_id is None] == [False]
    assert run(nothing, labels).count() == 0
    without = run(edge, labels.limit(0)).collect()
    assert len(without) == edge.count() and all(0 <= r.score <= 1 for r in without)


def test_kept_documents(edge, nothing, labels):
    kept = quality.kept(edge, labels)
    score = {(r.doc_id): r.score for r in quality.classify(edge, labels).collect()}
    assert kept.columns == edge.columns
    want = sum(score[r.doc_id] >= quality.THRESHOLD for r in edge.collect())
    assert kept.count() == want
    assert quality.kept(nothing, labels).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(4)

    def vector():
        t = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        w = rng.random(len(t)) + 0.1
        return t, w / np.sqrt(w @ w)

    examples = [vector() for _ in range(1000)]
    index = toxicity.BlockMaxIndex(examples, 40)
    dense = np.zeros((1000, 40))
    for i, (t, w) in enumerate(examples):
        dense[i, t] = w
    for _ in range(60):
        t, w = vector()
        query = np.zeros(40)
        query[t] = w
        cosine = dense @ query
        near, got = index.nearest(t, w, 15)
        want = np.lexsort((np.arange(1000), -np.round(cosine, 12)))[:15]
        assert np.allclose(got, cosine[want]) and np.allclose(cosine[near], got)


def test_terms_are_words_and_stems():
    found, owner = toxicity.terms(pa.array(["Hello, WORLDS hello", "", "hello!"]))
    # hello twice, worlds and its first five letters
    assert owner.tolist().count(0) == 2 + 2 and owner.tolist().count(2) == 1
    assert set(found[owner == 2].tolist()) <= set(found[owner == 0].tolist())


def words_and_stems(text):
    words = re.findall(r"[a-z0-9\x80-\xff]+", text.encode().decode("latin-1").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))
    return Counter(words) + Counter(("stem", w[: toxicity.STEM]) for w in words if len(w) > toxicity.STEM)


def plain_scores(examples, texts, weight):
    """Scores by whole vectors, every cosine computed; examples: (text, label, doc_id)."""
    counted = [(words_and_stems(t), c, i) for t, c, i in examples]
    df = [Counter(t for x, c, _ in counted if c == k for t in x) for k in (0, 1)]
    n = [sum(c == k for _, c, _ in counted) for k in (0, 1)]

    def term_weight(t):
        ratio = ((df[1][t] + 0.5) / (n[1] + 1)) / ((df[0][t] + toxicity.EASE) / (n[0] + 1))
        idf = np.log((len(counted) + 1) / (df[0][t] + df[1][t] + 1)) + 1
        known = df[0][t] + df[1][t] > 0
        return idf * (toxicity.LEAST_WEIGHT + max(np.log(ratio), 0)) if known else idf * toxicity.LEAST_WEIGHT

    def vector(x):
        v = {t: (1 + np.log(k)) * term_weight(t) for t, k in x.items()}
        length = np.sqrt(sum(w * w for w in v.values()))
        return {t: w / length for t, w in v.items()}

    total = {k: n[k] * weight[k] for k in (0, 1)}
    prior = total[1] / (total[0] + total[1])
    merged = {}
    for x, c, i in counted:
        if x:
            held = merged.setdefault(frozenset(x.items()), [vector(x), 0.0, 0.0])
            held[1] += weight[c] ** toxicity.RESTORED * c
            held[2] += weight[c] ** toxicity.RESTORED
    out = []
    for text in texts:
        x = words_and_stems(text)
        v = vector(x) if x else {}
        near = sorted(((sum(w * e.get(t, 0.0) for t, w in v.items()), a, b) for e, a, b in merged.values()), key=lambda r: -r[0])
        near = [r for r in near[: toxicity.NEIGHBOURS] if r[0] > 0]
        close = [r[0] / (1 + toxicity.NEAR - r[0]) for r in near]
        up = sum(a * c for c, (_, a, _) in zip(close, near)) + toxicity.PRIOR * prior
        out.append(((up / (sum(b * c for c, (_, _, b) in zip(close, near)) + toxicity.PRIOR)) if x else None, near[0][0] if near else 0.0))
    return out


@pytest.fixture(scope="module")
def labelled_texts():
    rng = random.Random(21)
    plain = ["".join(rng.choice("abcdeiou") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    bad = ["vile" + "".join(rng.choice("aeiou") for _ in range(4)) for _ in range(25)]

    def text(toxic):
        some = [rng.choice(plain) for _ in range(rng.randrange(8, 40))] + [rng.choice(bad) for _ in range(3 if toxic else rng.random() < 0.05)]
        rng.shuffle(some)
        return " ".join(some)

    labels = [int(rng.random() < 0.3) for _ in range(260)]
    return [(text(c), c, i) for i, c in enumerate(labels)], [text(rng.random() < 0.5) for _ in range(60)]


def model_of(examples, weight):
    rows = list(zip(examples, toxicity.term_counts(pa.array([e[0] for e in examples]))))
    number = {k: sum(e[1] == k for e in examples) for k in (0, 1)}
    return toxicity.Classifier([(f, n, e[1], e[2]) for e, (f, n) in rows], weight, number)


def test_scores_equal_those_of_all_cosines(labelled_texts):
    examples, others = labelled_texts
    weight = {0: 3.0, 1: 1.0}
    texts = others + ["", "unknown words only zzz", examples[3][0], examples[3][0] + " and unseenword"]
    got, _ = model_of(examples, weight).scores(pa.array(texts))
    for score, (want, _) in zip(got, plain_scores(examples, texts, weight), strict=True):
        assert want is None or score == pytest.approx(want, abs=1e-9)


def test_copies_of_toxic_examples_are_found(labelled_texts):
    examples, _ = labelled_texts
    toxic = [e for e in examples if e[1] == 1]
    model = model_of(examples, {0: 5.0, 1: 1.0})
    texts = pa.array([t for t, _, _ in toxic])
    for (found, count), (_, _, doc) in zip(toxicity.term_counts(texts), toxic):
        near, cosine = model.index.nearest(*model.vocabulary.vector(found, count), 15)
        assert cosine[0] == pytest.approx(1, abs=1e-12) and model.ids[near[0]] == doc
    scores, evidence = model.scores(texts)
    assert (scores >= toxicity.THRESHOLD).all() and all(e[0] == d for e, (_, _, d) in zip(evidence, toxic))


def test_every_labelled_toxic_text_of_the_table_is_toxic(spark):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    found = toxicity.classify(docs, labels).toPandas().set_index("doc_id")
    known = labels.toPandas().set_index("doc_id")
    both = found.join(known, how="inner")
    learned = both[~both.held_out & (both.toxic == 1)]
    assert len(learned) > 10 and (learned.predicted == 1).all()
