"""Language identification by known words with character n-gram backoff.

Training counts lower-cased words by language over a sample of the labelled
documents (whole texts), at most about SAMPLE_DOCS a language and all of those
that have fewer, so that a rare language is learnt next to a frequent one. The
model holds every word of the sample and every n-gram, of one to five
characters, of those words. A known word scores its log frequency in each
language; an unseen word scores the mean log frequency of its longest n-grams
that the model knows. A text's score is the sum over its words, turned into a
probability by softmax. Predictions read whole texts.

Cases: null texts and texts without a letter are ``und`` with score 0. Texts
take time in proportion to their length, whatever it is. Without labelled
documents all are ``und``. Ties go to the language that sorts first. Repeated
rows get equal results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._work import bounded_batches

# Bound of the training sample: documents a language, about. It is the only bound of the model.
SAMPLE_DOCS = 1_000
LONGEST = 5
CACHED_WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def _grams(word: str, n: int) -> list[str]:
    marked = f"_{word}_"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class _Table:
    """Log frequencies by key: a row number for each key, and one matrix."""

    def __init__(self, keys: dict[str, int], counts: np.ndarray):
        totals = counts.sum(axis=0) + 0.1 * len(counts)
        self.keys, self.logs = keys, np.log((counts + 0.1) / totals).astype(np.float32)

    def get(self, key: str) -> np.ndarray | None:
        at = self.keys.get(key)
        return None if at is None else self.logs[at]


class LanguageModel:
    """Log frequencies of words and n-grams by language."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        self.languages = sorted({lang for lang, _, _ in counts})
        number = {lang: i for i, lang in enumerate(self.languages)}
        size = len(self.languages)
        words: dict[str, int] = {}
        at = [words.setdefault(word, len(words)) for _, word, _ in counts]
        table = np.zeros((len(words), size))
        np.add.at(table, (at, [number[lang] for lang, _, _ in counts]), [n for _, _, n in counts])
        self.words, self.grams = _Table(words, table), []
        for n in range(1, LONGEST + 1):
            grams: dict[str, int] = {}
            place, owner = array("q"), array("q")
            for word, row in words.items():
                found = _grams(word, n)
                place.extend(grams.setdefault(gram, len(grams)) for gram in found)
                owner.extend([row] * len(found))
            sums = np.zeros((len(grams), size))
            for lang in range(size):
                sums[:, lang] = np.bincount(np.frombuffer(place, dtype=np.int64), weights=table[np.frombuffer(owner, dtype=np.int64), lang], minlength=len(grams)) if grams else 0
            self.grams.append(_Table(grams, sums))

    def word(self, word: str) -> np.ndarray:
        """Log score of a word in each language."""
        row = self.words.get(word)
        if row is not None:
            return row
        for n in range(LONGEST, 0, -1):
            known = [row for row in map(self.grams[n - 1].get, _grams(word, n)) if row is not None]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(self.languages), dtype=np.float32)


class Predictor:
    """Scores texts; remembers a bounded number of words."""

    def __init__(self, model: LanguageModel):
        self.model, self.seen = model, {}

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its probability, or ``und`` and 0."""
        found = Counter(_WORD.findall(text.lower())) if text else None
        if not found or not self.model.languages or not any(c.isalpha() for word in found for c in word):
            return "und", 0.0
        if len(self.seen) > CACHED_WORDS:
            self.seen.clear()
        seen, rows = self.seen, []
        for word in found:
            row = seen.get(word)
            if row is None:
                row = self.model.word(word)
                if len(word) <= 64:
                    seen[word] = row
            rows.append(row)
        total = np.fromiter(found.values(), dtype=np.float64, count=len(found)) @ np.array(rows, dtype=np.float64)
        best = int(total.argmax())
        return self.model.languages[best], float(1.0 / np.exp(np.maximum(total - total[best], -700.0)).sum())


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> LanguageModel:
    """Fit on about SAMPLE_DOCS documents of each language, chosen by a hash of the id."""
    sizes = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))
    limits = sizes.select("lang", F.when(F.col("n") <= SAMPLE_DOCS, F.lit(2**63 - 1)).otherwise(((F.lit(SAMPLE_DOCS) / F.col("n") - 0.5) * 2.0**64).cast("long")).alias("most"))
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(5), id_col).alias("draw"))
    sample = rows.join(F.broadcast(limits), "lang").filter(F.col("draw") <= F.col("most"))
    counts = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return LanguageModel(sorted((r[0], r[1], r[2]) for r in counts.collect()))


def identify(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, lang_pred, score; ``training`` says which rows may be learnt from."""
    model = train(docs.filter(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()), id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = None
        for batch in batches:
            predictor = predictor or Predictor(shared.value)
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = [predictor.predict(text.as_py()) for text in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                    names=[id_col, "lang_pred", "score"],
                )

    bounded_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double")
