"""The pipeline's stages, one by one on what the stage before kept, against plain Python."""

import re
import zlib

import numpy as np
import pytest
from llm.test_mixing import check as check_mix
from llm.test_near import classes
from llm.test_packing import check_pieces
from llm.test_secret_scan import spans_of
from tokenizers import Tokenizer

import corpus_pipeline
from pyspark.sql import functions as F
from shelfmark.llm import mixing, quality, tokens


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    junk = [(5000 + i, f"SHOUT{i}!! AGAIN!! " * 30) for i in range(40)]
    secret = [(6000 + i, f"{corpus[i][1]} password = secret{i}word end {i}") for i in range(10)]
    rows = [(i, t, "en", f"src{zlib.crc32(str(i).encode()) % 5}", len(t)) for i, t in corpus + junk + secret]
    rows += [(9000, None, "en", "src1", 0), (9001, "", None, None, 0), rows[3]]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(
        f"{path}/documents.parquet"
    )
    labels = [(i, 1, 0) for i, _ in corpus + secret] + [(i, 0, 0) for i, _ in junk]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, monkeypatch):
    names = ["quality classifier", "near-duplicates", "secret scans", "source mix", "packing"]
    assert [n for n, _ in corpus_pipeline.STAGES] == names
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pairs = lambda df: sorted((r.doc_id, r.text or "") for r in df.collect())

    kept = stage[names[0]](spark, docs, folder).cache()
    assert kept.columns == docs.columns
    score = {r.doc_id: r.score for r in quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert pairs(kept) == [p for p in pairs(docs) if score[p[0]] >= quality.THRESHOLD]
    assert not any(5000 <= i < 6000 for i, _ in pairs(kept))

    single = stage[names[1]](spark, kept, folder).cache()
    assert single.columns == docs.columns
    want = classes([(r.doc_id, r.text) for r in kept.collect()])
    assert [i for i, _ in pairs(single)] == sorted(set(want.values()))

    masked = stage[names[2]](spark, single, folder).cache()
    assert masked.columns == docs.columns
    before = dict(pairs(single))
    for i, text in pairs(masked):
        assert not spans_of(text) and (text == before[i]) == (not spans_of(before[i]))
    assert len(pairs(masked)) == len(before)

    mixed = stage[names[3]](spark, masked, folder).cache()
    assert mixed.columns == docs.columns
    found = mixing.mix(masked, F.array("source")).collect()
    check_mix([(r.doc_id, r.text, r.source) for r in masked.collect()], found)
    taken = {r.doc_id: r.taken // r.size for r in found if r.size}
    count = {}
    for i, text in pairs(mixed):
        assert text == dict(pairs(masked))[i]
        count[i] = count.get(i, 0) + 1
    assert count == {i: n for i, n in taken.items() if n}

    packed = stage[names[4]](spark, mixed, folder).collect()
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    rows = [(r.doc_id, r.text) for r in mixed.collect()]
    # Repeated rows give the same pieces again; lengths are compared in sum.
    total = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(p.length for p in packed) == total
    once = {i: t for i, t in rows}
    assert check_pieces(tokenizer, rows, packed, 2048) <= 1 and set(once) == {p.doc_id for p in packed}


def test_run_repeats_itself(spark, folder):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset)
    first, second = (sorted(map(key, corpus_pipeline.run(spark, folder).collect())) for _ in range(2))
    assert first == second and len(first) > 100
    assert np.unique([k[4] for k in first]).size > 1 and re.fullmatch(r"[\w -]+", corpus_pipeline.STAGES[0][0])
