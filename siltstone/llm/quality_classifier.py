"""A quality classifier without hand labels.

Overlapping heuristic labellers vote on each document (the counts and votes of
``quality_rules``); expectation-maximisation over the vote patterns of all
documents that pass the base estimates their accuracies. The posterior
probabilities (0 where the base rejects) label a bounded sample, on which a
logistic scorer over hashed features is trained: each word counts in the bucket
of its lower-case form and in that of its shape (runs of upper, lower, digit and
other characters), and words that make up much of a text also count in a
feature of that share. The scorer then rates every whole text.

Cases: null texts and texts without words score 0 and aren't kept. Repeated
rows get equal scores. An empty table gives an empty result. Extra columns are
ignored. Ids may be null. Very long texts take time and memory in proportion to
their length; rare words of any length are hashed whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._work import bounded_batches, stored
from siltstone.llm.quality_rules import base_failed, fit_rules, measured, votes

# Bounds: documents of the training sample (about) and hash buckets.
SAMPLE_DOCS = 4_000
BUCKETS = 4_096
CACHED_WORDS = 400_000
# Features of words that make up at least 1/2, 1/4, ... 1/2**SHARES of a text.
SHARES = 5
FEATURES = BUCKETS + SHARES
# Words that are added to each text's count: they draw very short texts to the offset.
DAMPING = 8

_RUN = re.compile(r"[^\W\d_]+|\d+")
_CAPITALS = re.compile(r"[^\W\d_a-zß-öø-ÿ]{2}")


def _short(run: re.Match) -> str:
    return "0" if run[0][0].isdecimal() else "A" if _CAPITALS.search(run[0]) else "a"


def shape(word: str) -> str:
    """The word with each run of digits as 0 and of letters as a, or A where it has two capitals in a row."""
    return _RUN.sub(_short, word)


def buckets(word: str) -> tuple[int, int]:
    """Hash buckets of a word and of its shape."""
    return zlib.crc32(word.lower().encode()) % (BUCKETS // 2), BUCKETS // 2 + zlib.crc32(shape(word).encode()) % (BUCKETS // 2)


def shares(words: Counter, total: int) -> list[int]:
    """For each feature of shares how many words of the text are in it."""
    out = [0] * SHARES
    for n in words.values():
        if n << SHARES >= total and n > 1:
            out[(total // n).bit_length() - 1 if total // n < 1 << SHARES else SHARES - 1] += n
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, values = [], []
        for text in batch.column(0).to_pylist():
            found: Counter = Counter()
            words = Counter((text or "").split())
            for word, n in words.items():
                for b in buckets(word):
                    found[b] += n
            found.update({BUCKETS + i: n for i, n in enumerate(shares(words, words.total())) if n})
            keys.append(list(found))
            values.append(list(found.values()))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int64())), batch.column(1)], names=["buckets", "counts", "label"])


def fit_scorer(rows: list, rounds: int = 300, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic scorer on relative bucket frequencies, by full-batch Adam."""
    if not rows:
        return np.zeros(FEATURES, dtype=np.float32), 0.0
    x = np.zeros((len(rows), FEATURES), dtype=np.float32)
    for i, (keys, counts, _) in enumerate(rows):
        if keys:
            words = sum(n for k, n in zip(keys, counts, strict=True) if k < BUCKETS) / 2
            x[i, keys] = np.array(counts, dtype=np.float32) / (words + DAMPING)
    y = np.array([r[2] for r in rows], dtype=np.float32)
    scale = np.sqrt((x * x).mean(axis=0)) + 1e-3
    x /= scale
    w, b = np.zeros(FEATURES, dtype=np.float32), 0.0
    m, v = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for t in range(1, rounds + 1):
        error = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) / len(rows)
        grad = np.append(x.T @ error + decay * w, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - float(step[-1])
    return w / scale, b


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """One row per document: id, score (double, 0 to 1) and kept."""
    bounded_batches(docs.sparkSession)
    key = F.xxhash64(F.lit(3), text_col)
    measures = stored(measured(docs.select(text_col, key.alias("__key")), text_col, ["__key"]), "measures")
    model = fit_rules(measures)
    rows = measures.count()
    limit = math.floor(min(1.0, SAMPLE_DOCS / max(1, rows)) * 2**64) - 2**63 - 1
    labels = measures.filter(F.col("__key") <= F.lit(limit)).dropDuplicates(["__key"]).select("__key", F.when(base_failed(), 0.0).otherwise(model.posterior(votes())).alias("label"))
    sample = docs.select(text_col, key.alias("__key")).filter(F.col("__key") <= F.lit(limit)).dropDuplicates(["__key"])
    found = sample.join(labels, "__key").select(text_col, "label").mapInArrow(_hashed, "buckets array<int>, counts array<bigint>, label double").collect()
    weights, offset = fit_scorer(sorted(((r[0], r[1], r[2]) for r in found), key=lambda r: (r[2], r[0], r[1])))
    kind = docs.schema[id_col].dataType.simpleString()
    by_share = weights[BUCKETS:].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                scores = []
                for text in part.column(1):
                    words = (text.as_py() or "").split()
                    found = Counter(words)
                    for word in [w for w in found if w not in known]:
                        a, b = buckets(word)
                        known[word] = float(weights[a] + weights[b])
                    seen = sum(map(known.__getitem__, words)) + sum(n * w for n, w in zip(shares(found, len(words)), by_share, strict=True) if n)
                    total = offset + seen / (len(words) + DAMPING) if words else -math.inf
                    scores.append(1 / (1 + math.exp(-max(total, -700.0))) if words else 0.0)
                    if len(known) > CACHED_WORDS:
                        known.clear()
                score = pa.array(scores, pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), score, pa.array([s >= least for s in scores], pa.bool_())], names=[id_col, "score", "kept"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, score double, kept boolean")
