"""Token ids of whole texts by the tokenizers library, as a stored table of packed ids.

A text is cut where the vocabulary's own pre-splitting always cuts: before a single blank with other characters beside
it, and before marks that end a word. Each distinct word is encoded once by the library, many words as one text, and
kept for a worker's further texts; texts are put together from the words' ids by Arrow.
Texts where white space of any kind lies on both sides of a blank, or which end with one, or that hold the
vocabulary's special string, go to the library whole. A line feed with other characters than white space on both sides
is a piece of the pre-splitting by itself: it opens a part, too, where all of a text's line feeds are such.
"""

from __future__ import annotations

import codecs
import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import batch_bytes, pieces_of, slices_by_size, stored, text_of

VOCABULARY = "byte_bpe_50k.json"
KEPT_WORDS = 1_000_000  # words that a worker keeps; beyond it, the half of them that it hasn't met for longest goes
LATIN = "".join(filter(str.isalpha, map(chr, range(0x250))))  # known to be letters for the pre-splitting
MARKS = ".,;:!?%&*#$"
MOST_MARKS = 100_000
TOGETHER = 500  # parts that are encoded as one text
PIECE = 8 << 20  # bytes of text whose words are looked up together
SPECIAL = "<|endoftext|>"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# White space between two of which a blank doesn't part a text (Unicode's, and some that only Python counts as such).
OTHER_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
AROUND, AFTER = re.compile(r"\s \s"), re.compile(r" \s")
BESIDE = re.compile(r"\n(?:\s|(?<=\s\n))")  # a line feed beside other white space
LINE = "\ufffe"  # a part that begins with it follows a line feed instead of a blank


def parted(text: str) -> bool:
    """Whether every blank of the text begins a piece of the vocabulary's pre-splitting."""
    if text[-1:] == " " or "  " in text or SPECIAL in text:
        return False
    beside = any(c in text and c + " " in text for c in OTHER_BLANKS if c < "\x80" or not text.isascii())
    return not (beside and AROUND.search(text))


def in_lines(text: str) -> str | None:
    """A text that every blank parts with its line feeds as parts' begins; None where LINE can't tell them."""
    if " " + LINE in text:
        return None
    if "\n" not in text or text[0] == "\n" or text[-1] == "\n" or BESIDE.search(text):
        return text
    return text.replace("\n", " " + LINE)


class Encoder:
    """Ids as packed little-endian 16-bit numbers.

    What is known of words lies in two Arrow arrays, the words and their ids, so that a table of parts is looked up
    and put together in a few calls; only words that are met for the first time become Python objects.
    """

    def __init__(self, path: str | None = None, kept: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self.kept = kept
        self.words = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.binary())
        self.met = np.zeros(0, np.int64)  # the call in which a word was last met
        self.calls = 0
        self.marks: dict[str, bytes] = {}
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.blank = split(" a")[0][0][0]
        self.begins = np.zeros(1 << 16, bool)  # ids that begin with a blank
        self.begins[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(self.blank)]] = True
        # a blank and letters are one piece of the pre-splitting: the model gets them as the pre-splitting would write them
        spelled = {b: x for c in LATIN for b, x in zip(c.encode(), split(c)[0][0])} | {ord(" "): self.blank, ord("\n"): " "}
        spelled[ord("\r")] = split("\n")[0][0][0]  # a line feed, as "\n" parts the words here
        (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.spelled = "".join(spelled.get(b, "\ufffe") for b in range(256))  # U+FFFE: none
        self.lettered = Tokenizer(self.tokenizer.model)
        self.lettered.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint16).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, parts: list[str]) -> list[bytes]:
        """Ids of parts, each with a blank before it: they follow each other in one text, a blank begins the next."""
        out: list[bytes] = []
        texts = [" " + " ".join(parts[low : low + TOGETHER]) for low in range(0, len(parts), TOGETHER)]
        for at, raw in enumerate(self._encode(texts)):
            some = parts[at * TOGETHER : (at + 1) * TOGETHER]
            first = np.flatnonzero(self.begins[np.frombuffer(raw, np.uint16)])
            # white space at a part's begin would meet that of the part before it
            if len(first) != len(some) or AFTER.search(texts[at]):
                out += self._encode([" " + p for p in some])
                continue
            place = (2 * first).tolist() + [len(raw)]
            out += [raw[i:j] for i, j in zip(place, place[1:])]
        return out

    def _new_lines(self, parts: list[str]) -> list[bytes]:
        """As _new, for parts that begin with LINE: a line feed is before each."""
        out: list[bytes] = []
        texts = ["".join(parts[low : low + TOGETHER]).replace(LINE, "\n") for low in range(0, len(parts), TOGETHER)]
        for at, raw in enumerate(self._encode(texts)):
            some = parts[at * TOGETHER : (at + 1) * TOGETHER]
            first = np.flatnonzero(np.frombuffer(raw, np.uint16) == self.line)
            # white space at a part's end would meet the next line feed
            if len(first) != len(some) or BESIDE.search(texts[at]):
                out += self._encode(["\n" + p[1:] for p in some])
                continue
            place = (2 * first).tolist() + [len(raw)]
            out += [raw[i:j] for i, j in zip(place, place[1:])]
        return out

    def _new_words(self, words: list[str], lines: bool = False) -> pa.BinaryArray:
        """As _new or, with lines, as _new_lines, for words of LATIN letters alone."""
        if not words:
            return pa.array([], pa.binary())
        if lines:
            texts = ["".join(words[low : low + TOGETHER])[1:].replace(LINE, "\n\r\n") for low in range(0, len(words), TOGETHER)]
        else:
            texts = ["\n ".join(words[low : low + TOGETHER]) for low in range(0, len(words), TOGETHER)]
        before = b"\r\n" if lines else b" "
        texts = [codecs.charmap_decode(before + text.encode(), "strict", self.spelled)[0] for text in texts]
        raw = np.concatenate([np.array(e.ids, np.uint16) for e in self.lettered.encode_batch_fast(texts, add_special_tokens=False)])
        first = np.flatnonzero(raw == self.line if lines else self.begins[raw])
        if len(first) != len(words):
            return pa.array(self._new_lines(words) if lines else self._new(words), pa.binary())
        return _packed(np.append(first, len(raw)) * 2, pa.py_buffer(raw))

    def _known(self, names: pa.Array, lettered: np.ndarray) -> pa.BinaryArray:
        """Ids of distinct words, each with a blank or, behind LINE, a line feed before it; lettered ones are of LATIN
        letters alone."""
        self.calls += 1
        at = pc.index_in(names, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        missed = at < 0
        if missed.any():
            lines = pc.starts_with(names, LINE).to_numpy(zero_copy_only=False)
            groups = [missed & some & kind for some in (lettered, ~lettered) for kind in (~lines, lines)]
            fresh = [names.filter(pa.array(g)) for g in groups]
            for group in groups:
                at[group] = len(self.met) + np.arange(group.sum())
                self.met = np.append(self.met, np.zeros(group.sum(), np.int64))
            parts = [f.to_pylist() for f in fresh]
            ids = [self._new_words(parts[0]), self._new_words(parts[1], lines=True)]
            ids += [pa.array(self._new(parts[2]), pa.binary()), pa.array(self._new_lines(parts[3]), pa.binary())]
            self.words, self.ids = pa.concat_arrays([self.words, *fresh]), pa.concat_arrays([self.ids, *ids])
        self.met[at] = self.calls
        found = self.ids.take(pa.array(at))
        if len(self.met) > self.kept:
            last = np.sort(np.argpartition(-self.met, self.kept // 2)[: self.kept // 2])
            self.words, self.ids, self.met = self.words.take(pa.array(last)), self.ids.take(pa.array(last)), self.met[last]
        return found

    def _parts(self, parts: pa.Array) -> pa.BinaryArray:
        """Ids of distinct parts, each with a blank or a line feed before it."""
        # a word with marks behind it is the word and the marks, which many words share
        words = pc.utf8_rtrim(parts, characters=MARKS)
        lettered = pc.match_substring_regex(words, f"^{LINE}?[{LATIN}]+$")
        names = pc.if_else(lettered, words, parts).dictionary_encode()
        own = np.zeros(len(names.dictionary), bool)
        place = names.indices.to_numpy()
        own[place] = lettered.to_numpy(zero_copy_only=False)
        ids = self._known(names.dictionary, own)
        marked = pc.and_(lettered, pc.not_equal(pc.binary_length(words), pc.binary_length(parts)))
        behind = zip(parts.filter(marked).to_pylist(), pc.utf8_length(words.filter(marked)).to_pylist())
        behind = pa.array([p[n:] for p, n in behind], pa.large_string()).dictionary_encode()
        kinds = behind.dictionary.to_pylist()
        if len(self.marks) > MOST_MARKS:
            self.marks = {}
        fresh = [m for m in kinds if m not in self.marks]
        self.marks.update(zip(fresh, self._encode(fresh)))
        both = pa.concat_arrays([ids, pa.array([b"", *[self.marks[m] for m in kinds]], pa.binary())])
        pairs = np.full((len(parts), 2), len(ids), np.int64)  # no marks
        pairs[:, 0] = place
        pairs[marked.to_numpy(zero_copy_only=False), 1] += 1 + behind.indices.to_numpy()
        return _joined(both, pairs.ravel(), np.arange(len(parts) + 1) * 2)

    def packed(self, texts: list[str], end: bytes = b"") -> pa.BinaryArray:
        """Ids of every text, with `end` behind them."""
        if not texts:
            return pa.array([], pa.binary())
        lined = [in_lines(text) if parted(text) else None for text in texts]
        cut = [text is not None for text in lined]
        split = pc.split_pattern(pa.array([text or "" for text in lined], pa.large_string()), " ")
        begins = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        place = coded.indices.to_numpy()
        # a text's first part has no blank before it: an entry of its own; so has a text that isn't cut
        firsts = coded.dictionary.take(pa.array(place[begins[:-1]])).to_pylist()
        firsts = self._encode([first if c else text for first, text, c in zip(firsts, texts, cut)])
        used = np.ones(len(place), bool)
        used[begins[:-1]] = False
        others = np.zeros(len(coded.dictionary), bool)
        others[place[used]] = True
        known = self._parts(coded.dictionary.filter(pa.array(others)))
        place = (np.cumsum(others) - 1)[place]
        place[begins[:-1]] = len(known) + np.arange(len(texts))
        entries = pa.concat_arrays([known, pa.array([*firsts, end], pa.binary())])
        place = np.insert(place, begins[1:], len(entries) - 1)
        return _joined(entries, place, begins + np.arange(len(begins)))

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.packed(texts).to_pylist()


def _packed(ends: np.ndarray, data: pa.Buffer) -> pa.BinaryArray:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), data])


def _joined(entries: pa.BinaryArray, place: np.ndarray, begins: np.ndarray) -> pa.BinaryArray:
    """The entries at `place`, those from one begin to the next put together."""
    _, ends, data = entries.take(pa.array(place)).buffers()
    return _packed(np.frombuffer(ends, np.int32)[begins], data if data is not None else pa.py_buffer(b""))


def encoder(path: str | None = None) -> Encoder:
    """The worker process's own encoder, kept for its further tasks with all that it has learnt."""
    kept = sys.__dict__.setdefault("_shelfmark_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def token_table(docs: DataFrame, end_id: int, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (packed, with end_id last) of every row; a null text is an empty one."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = encoder(path), np.array([end_id], np.uint16).tobytes()
        for batch in pieces_of(batches, PIECE):
            ids = known.packed(batch.column(1).to_pylist(), end)
            number = pc.divide(pc.binary_length(ids).cast(pa.int64()), 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), number, ids], names=["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(encode, "doc_id bigint, n_tokens bigint, ids binary")


def stored_tokens(docs: DataFrame, end_id: int, path: str | None = None) -> DataFrame:
    return stored(token_table(docs, end_id, path), "tokens")


def counted(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of all documents, by document and id: the document, the id, and how often it occurs there."""
    if not ids:
        return (np.zeros(0, np.int64),) * 3
    kind = np.uint32 if len(ids) <= 1 << 16 else np.uint64
    keys = np.concatenate(ids).astype(kind)
    keys |= np.repeat(np.arange(len(ids), dtype=kind) << kind(16), [len(x) for x in ids])
    keys.sort()
    opens = np.ones(len(keys) + 1, bool)
    np.not_equal(keys[1:], keys[:-1], out=opens[1:-1])
    at = np.flatnonzero(opens)
    keys = keys[at[:-1]].astype(np.int64)
    return keys >> 16, keys & 0xFFFF, np.diff(at)


def token_counts(tokens: DataFrame, per_document: bool = False) -> np.ndarray:
    """How often each id occurs, or in how many rows; the result has one entry per 16-bit id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            if not per_document:
                total += np.bincount(batch_bytes(batch.column(0))[0].view(np.uint16), minlength=1 << 16)
                continue
            ids = [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(0)]
            for low, high in slices_by_size(batch_bytes(batch.column(0))[1], PIECE):
                total += np.bincount(counted(ids[low:high])[1], minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["id", "n"])

    found = tokens.select("ids").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << 16, np.int64)  # at most as many rows as ids
    for row in found:
        out[row.id] = row.n
    return out
