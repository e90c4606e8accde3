"""Packed pieces and coded files against the tokenizers library."""

import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from shelfmark.llm import packing, rans, tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.vocabulary_path())


def ids_of(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_parts_give_the_library_s_ids(tokenizer, corpus, edge):
    texts = [t for _, t in corpus] + [r.text or "" for r in edge.collect()]
    texts += [" lead", "two  blanks", "x \n y", "end ", "\n", "a  b", "it's '' 's", "½ ª º", "l'é, a...", "tab\t x", "ŁÓDŹ ƀƁ", "a!b c?d,", "¡ñ!"]
    got = tokens.Encoder().encode(texts)
    assert [np.frombuffer(g, np.uint16).tolist() for g in got] == [ids_of(tokenizer, t, 0)[:-1] for t in texts]


def test_short_texts_of_all_white_space(tokenizer):
    """Every text of up to five of these characters, and longer ones at random over all white space."""
    texts = ["".join(t) for n in range(6) for t in itertools.product("a \n\t\xa0\u2003", repeat=n)]
    rng = random.Random(1)
    others = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    for _ in range(3000):
        texts.append("".join(rng.choice([" ", " ", "a", "Bc", "1", ".", "'s", rng.choice(others)]) for _ in range(rng.randrange(2, 14))))
    texts += [" \xa0 \xa0", "intro \xa0 \xa0 end", "x\u3000 y", "x \u3000y", "x \u3000 y"]
    want = [np.array(e.ids, np.uint16).tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert tokens.Encoder().encode(texts) == want
    one_by_one = tokens.Encoder(kept=3)  # parts come and go
    assert [one_by_one.encode([t])[0] for t in texts[-1500:]] == want[-1500:]


def test_words_are_encoded_once_and_kept_within_bounds(tokenizer):
    """Words of all letters, with and without marks; texts that aren't cut lie between others."""
    rng = random.Random(3)
    names = ["".join(rng.choices(tokens.LATIN, k=rng.randrange(1, 9))) for _ in range(300)] + list(tokens.LATIN)
    texts = [" ".join(rng.choice(names) + rng.choice(["", ".", ",;", "!\n"]) for _ in range(40)) for _ in range(60)]
    texts[7:7] = ["", "two  blanks", "end "]
    want = [np.array(ids_of(tokenizer, t, 9), np.uint16).tobytes() for t in texts]
    known = tokens.Encoder(kept=50)
    assert known.packed(texts, np.array([9], np.uint16).tobytes()).to_pylist() == want
    assert len(known.words) == len(known.ids) <= 50

    fresh = tokens.Encoder()
    fresh.packed(["x " + " ".join(names)])
    fresh._new = fresh._new_words = None  # all are known, whatever marks follow
    marked = "x " + ". ".join(names) + "?!"
    assert np.frombuffer(fresh.packed([marked])[0].as_py(), np.uint16).tolist() == ids_of(tokenizer, marked, 0)[:-1]


def test_words_behind_a_line_feed_are_known_by_themselves(tokenizer):
    rng = random.Random(4)
    parts = ["".join(rng.choices(tokens.LATIN, k=rng.randrange(1, 9))) for _ in range(2000)] + ["a1", "it's", "don't!", "¿qué", "漢字", "x\t", "7"]
    known = tokens.Encoder()
    marks = ["", ",", "!?"]
    known.packed(["x " + " ".join(parts) + "." + "".join("\n" + p + rng.choice(marks) for p in parts) + "."])
    texts = ["x " + " ".join(a + rng.choice(marks) + "\n" + b for a, b in zip(parts[:2000], rng.sample(parts[:2000], 2000)))]
    want = [np.array(ids_of(tokenizer, t, 9), np.uint16).tobytes() for t in texts]
    known._new = known._new_words = None  # every pair of words is new, no word is
    assert known.packed(texts, np.array([9], np.uint16).tobytes()).to_pylist() == want

    mark = tokens.LINE
    texts = ["a\nb", "a \nb", "a\n b c", "a\n\nb c", "\na\nb", "a\nb\n", "a\r\nb c", "a\n\xa0b", "a\x85\nb"]
    texts += [mark, mark + "a\nb", "a " + mark + "b\nc", "a\n" + mark + "b c\nd", "a\nb" + mark + "c " + "d\ne", f"a\n{mark}\nb c\nb"]
    texts += ["".join(rng.choice([*parts, "\n", "\n", " ", mark, "."]) for _ in range(12)) for _ in range(2000)]
    lined = tokens.Encoder()
    for some in (texts, *([t] for t in texts[:300])):
        want = [np.array(ids_of(tokenizer, t, 0)[:-1], np.uint16).tobytes() for t in some]
        assert lined.encode(some) == want


def check_pieces(tokenizer, rows, found, window):
    want = {}
    for doc_id, text in rows:
        want.setdefault(doc_id, []).append(ids_of(tokenizer, text, 1))
    count = {}
    for p in found:
        some = [i[p.start : p.start + p.length] for i in want[p.doc_id] if len(i) == p.doc_tokens]
        assert p.ids_crc32 in {crc(s) for s in some if len(s) == p.length}
        count[p.doc_id] = count.get(p.doc_id, 0) + p.length
    assert count == {d: sum(map(len, i)) for d, i in want.items()}
    sequences = {}
    for p in found:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    short = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        short += at < window
    return short


def test_packing_edges(tokenizer, edge, nothing):
    found = packing.packed(edge).collect()
    assert check_pieces(tokenizer, [(r.doc_id, r.text) for r in edge.collect()], found, 2048) <= 1
    assert packing.packed(nothing).count() == 0


def test_packing_in_shards(tokenizer, corpus_docs, corpus, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 30_000)
    monkeypatch.setattr(packing, "CHUNK", 700)
    found = packing.packed(corpus_docs, window=256).collect()
    shards = len({p.sequence_id >> 32 for p in found})
    assert shards > 1
    assert check_pieces(tokenizer, corpus, found, 256) <= shards


def test_near_texts_share_a_shard_at_every_number_of_shards(spark, monkeypatch):
    rng = np.random.default_rng(5)
    word = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(150):
        some = rng.integers(0, 900, 200)
        near = some.copy()
        near[rng.integers(0, 200, 5)] = 7
        for copy in (some, near):
            rows.append((len(rows), " ".join(word[k] for k in copy)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for most in (60_000, 12_000):
        monkeypatch.setattr(packing, "SHARD_TOKENS", most)
        shards = {}
        for p in packing.packed(docs, window=256).collect():
            shards.setdefault(p.doc_id, set()).add(p.sequence_id >> 32)
        assert len({s for found in shards.values() for s in found}) > 2
        together = [bool(shards[i] & shards[i + 1]) for i in range(0, len(rows), 2)]
        assert np.mean(together) > 0.95


def test_hot_text_is_spread(spark, monkeypatch):
    """A text in most rows, without ids: its shards stay bounded."""
    monkeypatch.setattr(packing, "SHARD_TOKENS", 3_000)
    rows = [(None, "same words here " * 20)] * 300 + [(i, f"other{i} text " * 20) for i in range(100)]
    found = packing.packed(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), window=64).collect()
    size = {}
    for p in found:
        size[p.sequence_id >> 32] = size.get(p.sequence_id >> 32, 0) + p.length
    assert sum(size.values()) / len(size) > 1_000 and max(size.values()) <= 9_000


def test_windows_go_on_beyond_the_first_candidates():
    """A seed shares its one rare id with 200 short documents: all of them come before others."""
    ids = [np.array([5] * 3 + list(range(1000, 1040)), np.uint16)]
    ids += [np.array([2000 + i, 2001 + i], np.uint16) for i in range(0, 400, 2)]
    ids += [np.array([5, 3000 + i], np.uint16) for i in range(200)]
    pieces = packing.pack(ids, np.ones(1 << 16), 3.0, window=443)
    first = {doc for doc, *_, sequence, _ in pieces if sequence == 0}
    assert first == {0, *range(201, 401)}


def test_dropping_used_documents_changes_no_score():
    rng = np.random.default_rng(8)
    ids = [rng.zipf(1.3, rng.integers(2, 60)).clip(0, 3000).astype(np.uint16) for _ in range(120)]
    unused = rng.random(120) < 0.5
    index = packing.Index(ids, np.linspace(3, 1, 1 << 16), 30.0)
    before = [index.scores(i, unused) for i in range(120)]
    index.kept(unused)
    for i in range(120):
        assert np.allclose(before[i], index.scores(i, unused))


def test_index_ranks_by_bm25():
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, 60, rng.integers(5, 40)).astype(np.uint16) for _ in range(50)]
    frequency = np.zeros(1 << 16)
    for x in ids:
        frequency[np.unique(x)] += 1
    idf = np.log1p((50 - frequency + 0.5) / (frequency + 0.5))
    mean = np.mean([len(x) for x in ids])
    index = packing.Index(ids, idf, mean)
    unused = np.ones(50, bool)
    unused[[0, 3]] = False

    def weight(t, x):
        f = (x == t).sum()
        return idf[t] * f * (packing.K1 + 1) / (f + packing.K1 * (1 - packing.B + packing.B * len(x) / mean)) if f else 0.0

    terms = sorted(set(ids[0].tolist()), key=lambda t: -weight(t, ids[0]))[: packing.QUERY_TERMS]
    score = [sum(weight(t, x) for t in terms) if unused[i] else 0.0 for i, x in enumerate(ids)]
    best = index.neighbours(0, unused)
    assert best[0] == int(np.argmax(score)) and not {0, 3} & set(best.tolist())
    assert np.all(np.diff([score[i] for i in best]) <= 1e-9)


def test_files_round_trip(tokenizer, edge, nothing, corpus_docs, corpus, monkeypatch):
    monkeypatch.setattr(rans, "PARTITION_TOKENS", 20_000)
    for docs, rows in ((edge, [(r.doc_id, r.text) for r in edge.collect()]), (corpus_docs, corpus)):
        ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
        found = sorted(rans.round_trip(docs).collect(), key=lambda r: r.start)
        at = 0
        for (doc_id, text), r in zip(ordered, found, strict=True):
            ids = ids_of(tokenizer, text, 2)
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), crc(ids))
            at += len(ids)
    assert rans.round_trip(nothing).count() == 0


def test_small_blocks_split_documents(tokenizer, corpus_docs, corpus, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", 300)
    monkeypatch.setattr(rans, "LANES", 16)
    monkeypatch.setattr(rans, "SEGMENT", 4)
    want = {d: crc(ids_of(tokenizer, t, 2)) for d, t in corpus}
    assert {r.doc_id: r.ids_crc32 for r in rans.round_trip(corpus_docs).collect()} == want


def test_coder_segments_and_damage():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 400_000), 60_000).astype(np.uint16)
    freq = rans.frequencies(np.bincount(ids, minlength=1 << 16))
    assert int(freq.sum()) == 1 << rans.SCALE
    coder = rans.Coder(freq)
    for n in (1, rans.LANES - 1, rans.LANES, rans.BLOCK, 200_001):
        coded = coder.encode(ids[:n])
        assert (coder.decode(*coded, n) == ids[:n]).all()
    words, states, positions, crcs = coder.encode(ids[:200_001])
    last = coder.segment(words, states, positions, crcs, 200_001, len(positions) - 1)
    assert (last == ids[: 200_001][(len(positions) - 1) * rans.SEGMENT * rans.LANES :]).all()
    damaged = bytes([words[0] ^ 1]) + words[1:]
    with pytest.raises(ValueError):
        coder.decode(damaged, states, positions, crcs, 200_001)


def test_frequencies_keep_rare_ids():
    counts = np.zeros(1 << 16, np.int64)
    counts[:60_000] = 1
    counts[7] = 10**9
    freq = rans.frequencies(counts)
    assert int(freq.sum()) == 1 << rans.SCALE and (freq[:60_000] >= 1).all() and (freq[60_000:] == 0).all()
