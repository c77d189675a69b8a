"""Hashed word shingles of whole texts, and packed exchanges of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

from siltstone.llm._work import settled

WIDTH = 5
# Shingle hashes of a flush of the packed exchange, about.
FLUSH = 1_000_000

_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S1, _S2 = np.uint64(29), np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = (x ^ (x >> _S2)) * _P1
    x = (x ^ (x >> _S1)) * _P2
    return x ^ (x >> _S2)


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text.

    A-Z are lowered and words are runs of anything but ASCII white space. A
    text of fewer words than the width is one shingle; without words it has none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = mixed(out + hashes[k : k + n])
    return np.unique(out)


def fingerprint(tokens: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    total = np.array([mixed(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))], dtype=np.uint64)
    return int(mixed(total).view(np.int64)[0])


def in_half(tokens: np.ndarray) -> np.ndarray:
    """Whether a hash is in the half of the hash space that the first filter looks at."""
    return (tokens & np.uint64(1)) == 0


def bucket_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the upper 32 bits."""
    return (((tokens >> _S2) * np.uint64(buckets)) >> _S2).astype(np.int64)


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, text, th): (id, th, n, half, f): set size, its part in the half space, fingerprint."""
    for batch in batches:
        n, half, f = [], [], []
        for text in batch.column(1).cast(pa.binary()):
            tokens = shingle_set(text.as_py())
            n.append(len(tokens))
            half.append(int(in_half(tokens).sum()))
            f.append(fingerprint(tokens) if len(tokens) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(half, pa.int64()), pa.array(f, pa.int64())], names=["id", "th", "n", "half", "f"])


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text): (f, tokens) for each text with words; equal neighbours in a batch once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            found = {}
            for text in batch.slice(at, 500).column(0).cast(pa.binary()):
                tokens = shingle_set(text.as_py())
                if len(tokens):
                    found[fingerprint(tokens)] = tokens.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["f", "tokens"])


ASK_SCHEMA = "bucket long, low binary, high binary, owner binary, owners binary, known binary, counts binary"
_LOCAL = 0xFFFF


class _Asks:
    """Texts' half-space shingles, gathered and split into one packed row per bucket."""

    def __init__(self, buckets: int):
        self.buckets, self.owners, self.tokens, self.held, self.seen = buckets, [], [], 0, set()

    def add(self, tokens: np.ndarray) -> None:
        f = fingerprint(tokens)
        if f not in self.seen:
            self.seen.add(f)
            self.owners.append(f)
            self.tokens.append(tokens[in_half(tokens)])
            self.held += len(self.tokens[-1])

    def full(self) -> bool:
        return self.held >= FLUSH or len(self.owners) >= _LOCAL - 1

    def flush(self) -> pa.RecordBatch:
        tokens = np.concatenate(self.tokens)
        owner = np.repeat(np.arange(len(self.owners)), [len(t) for t in self.tokens])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        new = np.append(True, tokens[1:] != tokens[:-1]) if len(tokens) else np.zeros(0, dtype=bool)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(tokens)))
        shared = np.repeat(sizes > 1, sizes)
        known = np.bincount(owner[shared], minlength=len(self.owners))
        owner = np.where(sizes > 1, _LOCAL, owner[starts])
        tokens = tokens[starts]
        bucket = bucket_of(tokens, self.buckets)
        keys = np.array(self.owners, dtype=np.int64)
        rows: list[tuple] = []
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
        for i, start in enumerate(cuts):
            end = cuts[i + 1] if i + 1 < len(cuts) else len(bucket)
            part = owner[start:end]
            used, place = np.unique(part, return_inverse=True)
            marked = used == _LOCAL
            names = np.append(keys, 0)[np.where(marked, len(keys), used)]
            place = np.where(part == _LOCAL, _LOCAL, place)
            rows.append((int(bucket[start]), tokens[start:end].astype("<u4").tobytes(), (tokens[start:end] >> _S2).astype("<u1").tobytes(), place.astype("<u2").tobytes(), names.astype("<i8").tobytes(), b"", b""))
        if known.any():
            which = np.flatnonzero(known)
            rows.append((int(self.owners[0] % self.buckets), b"", b"", b"", b"", keys[which].tobytes(), known[which].astype("<i8").tobytes()))
        self.__init__(self.buckets)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 7)]], names=["bucket", "low", "high", "owner", "owners", "known", "counts"])


def asker(buckets: int):
    """From (text): packed rows (ASK_SCHEMA) that ask which shingles other sets share.

    A flush names each shingle once. Those that two different sets of the flush
    hold are known to be shared and name no owner; their number by owner goes
    along as (known, counts). So a frequent shingle costs one entry a flush.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks = _Asks(buckets)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                tokens = shingle_set(text.as_py())
                if len(tokens):
                    asks.add(tokens)
                    if asks.full():
                        yield asks.flush()
        if asks.owners:
            yield asks.flush()
        settled()

    return run


def answered(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: (f, shared), how many of a set's shingles another set has too."""
    keys, counts, tokens, owners = [], [], [], []
    for row in rows.itertuples(index=False):
        if row.known:
            keys.append(np.frombuffer(row.known, dtype=np.int64))
            counts.append(np.frombuffer(row.counts, dtype=np.int64))
        if row.low:
            tokens.append(np.frombuffer(row.low, dtype="<u4").astype(np.uint64) | (np.frombuffer(row.high, dtype="<u1").astype(np.uint64) << _S2))
            place = np.frombuffer(row.owner, dtype="<u2").astype(np.int64)
            names = np.frombuffer(row.owners, dtype="<i8")
            owners.append(np.stack([names[np.where(place == _LOCAL, 0, place)], (place == _LOCAL).astype(np.int64)]))
    if tokens:
        token, (owner, local) = np.concatenate(tokens), np.concatenate(owners, axis=1)
        order = np.lexsort((owner, local, token))
        token, owner, local = token[order], owner[order], local[order]
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        sizes = np.diff(np.append(starts, len(token)))
        last = np.append(starts[1:], len(token)) - 1
        # Entries of a shingle are ordered by owner, those without an owner last.
        several = (owner[starts] != owner[last]) | (local[last] == 1)
        first = np.append(True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1]))
        hit = np.repeat(several, sizes) & first & (local == 0)
        found, n = np.unique(owner[hit], return_counts=True)
        keys.append(found)
        counts.append(n)
    if not keys:
        return pd.DataFrame({"f": np.zeros(0, dtype=np.int64), "shared": np.zeros(0, dtype=np.int64)})
    out = pd.DataFrame({"f": np.concatenate(keys), "shared": np.concatenate(counts)})
    del tokens, owners, keys, counts
    settled()
    return out


def count_asks(buckets: int):
    """Of one block of sets: a packed row per bucket with its shingles and their counts here."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        tokens, counts = np.unique(np.concatenate([np.asarray(t, dtype=np.int64) for t in block["tokens"]]).view(np.uint64), return_counts=True)
        bucket = bucket_of(tokens, buckets)
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(cuts[1:], len(bucket))
        return pd.DataFrame(
            {
                "bucket": bucket[cuts],
                "block": int(block["block"].iloc[0]),
                "tokens": [tokens[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)],
                "counts": [counts[a:b].astype("<u4").tobytes() for a, b in zip(cuts, ends, strict=True)],
            }
        )

    return run


def count_answers(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: for each block its shingles that occur in two sets or more, with their counts."""
    tokens = np.concatenate([np.frombuffer(t, dtype=np.uint64) for t in rows["tokens"]])
    counts = np.concatenate([np.frombuffer(c, dtype="<u4") for c in rows["counts"]]).astype(np.float64)
    names, at = np.unique(tokens, return_inverse=True)
    total = np.minimum(np.bincount(at, weights=counts), 2**31 - 1)[at].astype(np.int64)
    out, begin = [], 0
    for block, t in zip(rows["block"], rows["tokens"], strict=True):
        end = begin + len(t) // 8
        keep = total[begin:end] > 1
        if keep.any():
            out.append((block, tokens[begin:end][keep].tobytes(), total[begin:end][keep].astype("<u4").tobytes()))
        begin = end
    return pd.DataFrame(out, columns=["block", "tokens", "counts"])


def ordered(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """Of one block: each set's shared shingles, the rarest first, and its size n."""
    if not len(answers) or not len(block):
        return pd.DataFrame([], columns=["f", "n", "tokens"], dtype=object)
    tokens = np.concatenate([np.frombuffer(t, dtype=np.uint64) for t in answers["tokens"]])
    counts = np.concatenate([np.frombuffer(c, dtype="<u4") for c in answers["counts"]]).astype(np.int64)
    order = np.argsort(tokens)
    tokens, counts = tokens[order], counts[order]
    out = []
    for f, own in zip(block["f"], block["tokens"], strict=True):
        own = np.asarray(own, dtype=np.int64).view(np.uint64)
        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
        hit = tokens[at] == own
        own_tokens, own_counts = own[hit], counts[at[hit]]
        by = np.lexsort((own_tokens, own_counts))
        out.append((f, len(own), own_tokens[by].view(np.int64)))
    return pd.DataFrame(out, columns=["f", "n", "tokens"])
