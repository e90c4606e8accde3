"""Secrets against Python's regular expressions; the ledger scans only what it lacks."""

import random
import re

from pyspark.sql import functions as F

from shelfmark.llm import secret_scan

PATTERNS = (
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
)


def spans_of(text):
    found = []
    for at, (kind, pattern, group, least) in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            if len(m[group]) >= least:
                found.append((m.start(), at, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def texts():
    rng = random.Random(4)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", ":", "=", " ", "'", '"', "abc", "abcdef12", "AKIA", "ABCDEFGHIJKLMNOPQRST",
             "0123456789abcdef", "ß🙂", "\n", "x-y/z", ";", "ſecret", "toKen"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(600)]


def test_spans_equal_pythons(spark, edge):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for frame in (docs, edge):
        want = sorted((r.doc_id or -1, spans_of(r.text)) for r in frame.collect())
        got = secret_scan.find_secrets(frame).select("doc_id", secret_scan.label(F.col("spans")).alias("s")).collect()
        assert sorted((r.doc_id or -1, r.s) for r in got) == want


def test_masked_texts_hold_no_secret(spark, edge, nothing):
    rows = [(i, t, "extra") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    before = dict((r[0], r[1]) for r in rows)
    out = secret_scan.without_secrets(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        if spans_of(before[r.doc_id]):
            assert secret_scan.MASK in r.text
        else:
            assert r.text == before[r.doc_id]
    texts_of = lambda df: sorted((r.doc_id or -1, r.text or "") for r in df.collect() if not spans_of(r.text))
    assert len(secret_scan.without_secrets(edge).collect()) == edge.count()
    clean = {x for x in texts_of(edge)}
    assert clean <= set(texts_of(secret_scan.without_secrets(edge)))
    assert secret_scan.without_secrets(nothing).count() == 0 and secret_scan.find_secrets(nothing).count() == 0


def test_only_unseen_blobs_are_scanned(spark):
    first = spark.createDataFrame([("a.txt", 1, "token=abcdef1"), ("b.txt", 1, "clean")], "path string, version int, content string")
    ledger = secret_scan.update_ledger(first)
    assert ledger.count() == 2
    later = spark.createDataFrame(
        [("a.txt", 1, "token=abcdef1"), ("a.txt", 2, "token=abcdef1 more"), ("c.txt", 1, "clean"), ("d.txt", 1, None)],
        "path string, version int, content string",
    )
    new = secret_scan.update_ledger(later, ledger)
    assert new.count() == 2  # the second version of a.txt, and the empty text
    assert secret_scan.update_ledger(later, ledger, "rules-2").count() == 4
    whole = ledger.unionByName(new)
    rows = later.withColumn("blob_id", secret_scan.blob_id(F.coalesce("content", F.lit(""))))
    found = {(r.path, r.version): len(r.spans) for r in secret_scan.join_findings(rows, whole).collect()}
    assert found == {("a.txt", 1): 1, ("a.txt", 2): 1, ("c.txt", 1): 0, ("d.txt", 1): 0}


def test_plan_has_no_python(corpus_docs):
    plan = secret_scan.find_secrets(corpus_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
