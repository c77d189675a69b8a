"""Packing of tokenised documents into sequences of one window.

Each partition packs its own documents, in buffers of bounded size, so nothing
is shuffled. A document longer than the window is first cut into full windows.
What remains goes through best-fit decreasing: a segment tree over the
remaining capacities 1..window finds the tightest open sequence. Sequences that
then lack more than ``slack`` tokens are filled with cut pieces of the emptiest
ones; the last of a buffer is cut into sequences whose lengths are powers of
two, which need no padding.

Cases: null text counts as empty; an empty document is its end token alone.
Repeated rows are packed as often as they occur. Ids may be null. An empty
table gives an empty result. Extra columns are ignored. Very long texts are
tokenised whole. The result depends on the order of rows within partitions,
which a scan of files repeats when a task runs again; of a table dealt out
anew the sequences differ, the ids of each document don't.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from siltstone.llm._work import bounded_batches, settled

WINDOW = 4096
BUFFER_TOKENS = 1_000_000
# Words longer than this go to the tokenizer itself, whose merging doesn't take quadratic time.
LONG_WORD = 400

# Fixed values of the vocabulary: how tokens that end a word are marked, its normaliser and its rule for words.
WORD_END = "</w>"
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

# Texts of these characters are stable under the normaliser but for their case, and their letters and numbers are
# those of the two classes below: Latin-1 without controls and odd blanks, and general punctuation.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xff\u2010-\u2027\u2030-\u205e\u20ac\u2122]*")
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORD = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of texts as little-endian bytes, equal to those of the tokenizer file.

    Plain texts are split into words here and merged by a second engine that
    knows the same ranks; a zero byte behind each word stands for the mark of a
    word's end. Other texts, those that may hold special tokens, those with very
    long words, and all texts of vocabularies of another kind go through the
    tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.fast = self._engine(json.load(file))

    @staticmethod
    def _engine(made: dict):
        import tiktoken

        model = made["model"]
        words = [x["pattern"].get("Regex") for x in (made["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END or (made["normalizer"] or {}).get("normalizers") != NORMALIZER or words != [WORDS]:
            return None
        letters, ranks = _bytes_of_letters(), {}
        for token, number in model["vocab"].items():
            body = token.removesuffix(WORD_END)
            if all(c in letters for c in body):
                ranks[bytes(letters[c] for c in body) + (b"\0" if body != token else b"")] = number
        return tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out: list[bytes | None] = []
        for text in texts:
            words = _WORD.findall(text.lower()) if self.fast and "<|" not in text and _PLAIN.fullmatch(text) else None
            if words is None or (words and max(map(len, words)) > LONG_WORD):
                out.append(None)
                continue
            words.append("")
            out.append(np.array(self.fast.encode_ordinary("\0".join(words)), dtype="<u4").tobytes())
        others = [i for i, ids in enumerate(out) if ids is None]
        for i, found in zip(others, self.tokenizer.encode_batch_fast([texts[i] for i in others], add_special_tokens=False), strict=True):
            out[i] = np.array(found.ids, dtype="<u4").tobytes()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The tokenizer of this Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class CapacityTree:
    """Open sequences by remaining capacity; finds the tightest that fits."""

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.any = bytearray(2 * self.base)
        self.open: dict[int, list[int]] = {}

    def put(self, capacity: int, sequence: int) -> None:
        if capacity <= 0:
            return
        self.open.setdefault(capacity, []).append(sequence)
        at = self.base + capacity
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (capacity, sequence) of the tightest fit."""
        at, has = self.base + length, self.any
        while not has[at]:
            while at & 1:
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.base:
            at = 2 * at if has[2 * at] else 2 * at + 1
        capacity = at - self.base
        sequence = self.open[capacity].pop()
        if not self.open[capacity]:
            has[at] = 0
            at >>= 1
            while at and not has[2 * at] and not has[2 * at + 1]:
                has[at] = 0
                at >>= 1
        return capacity, sequence


def pack_lengths(lengths: list[int], window: int = WINDOW, slack: int = 32) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) for documents of these lengths."""
    sequences: list[list[tuple[int, int, int]]] = []
    rest = []
    for doc, total in enumerate(lengths):
        whole = total // window * window
        sequences += [[(doc, start, window)] for start in range(0, whole, window)]
        if total > whole:
            rest.append((doc, whole, total - whole))
    rest.sort(key=lambda p: -p[2])
    tree, filled = CapacityTree(window), {}
    for piece in rest:
        found = tree.take(piece[2])
        if found is None:
            found = window, len(sequences)
            sequences.append([])
        capacity, at = found
        sequences[at].append(piece)
        filled[at] = window - capacity + piece[2]
        tree.put(capacity - piece[2], at)
    loose = [at for at, n in filled.items() if window - n > slack and n & (n - 1)]
    loose.sort(key=lambda at: (-filled[at], at))
    first, last = 0, len(loose) - 1
    while first < last:
        into, source = loose[first], loose[last]
        gap = window - filled[into]
        doc, start, length = sequences[source].pop()
        taken = min(gap, length)
        sequences[into].append((doc, start, taken))
        filled[into] += taken
        filled[source] -= taken
        if taken < length:
            sequences[source].append((doc, start + taken, length - taken))
        if not sequences[source]:
            last -= 1
        if filled[into] == window:
            first += 1
    if first == last and filled[loose[first]] & (filled[loose[first]] - 1):
        pieces, sequences[loose[first]] = sequences[loose[first]], []
        left = filled[loose[first]]
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            part = []
            while size:
                doc, start, length = pieces.pop()
                taken = min(size, length)
                part.append((doc, start, taken))
                size -= taken
                if taken < length:
                    pieces.append((doc, start + taken, length - taken))
            sequences.append(part)
    return [s for s in sequences if s]


def _flushed(ids: list, tokens: list[bytes], schema: pa.Schema, window: int, next_id: int) -> tuple[pa.RecordBatch, int]:
    columns: list[list] = [[] for _ in schema]
    for sequence in pack_lengths([len(t) // 4 for t in tokens], window):
        offset = 0
        for doc, start, length in sequence:
            row = (ids[doc], start, length, tokens[doc][4 * start : 4 * (start + length)], len(tokens[doc]) // 4, next_id, offset)
            for column, value in zip(columns, row, strict=True):
                column.append(value)
            offset += length
        next_id += 1
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema), next_id


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 2) -> DataFrame:
    """One row per piece: id, start, length, ids (binary), doc_tokens, sequence_id, offset.

    ``ids`` holds unsigned 32-bit little-endian token ids. sequence_id is the
    partition's number in the high 32 bits and a running number in the low.
    """
    kind = docs.schema[id_col].dataType
    schema = f"{id_col} {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        ids, tokens, held, arrow = [], [], 0, None
        next_id = TaskContext.get().partitionId() << 32
        for batch in batches:
            coder = coder or encoder(tokenizer)
            arrow = arrow or pa.schema(
                [(id_col, batch.schema.field(0).type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
            )
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                encoded = [x + end for x in coder.encode([t or "" for t in part.column(1).to_pylist()])]
                ids += part.column(0).to_pylist()
                tokens += encoded
                held += sum(map(len, encoded)) // 4
                if held >= BUFFER_TOKENS:
                    out, next_id = _flushed(ids, tokens, arrow, window, next_id)
                    ids, tokens, held = [], [], 0
                    yield out
        if ids:
            yield _flushed(ids, tokens, arrow, window, next_id)[0]
        ids, tokens = [], []
        settled()

    bounded_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, schema)
