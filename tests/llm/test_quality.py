import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import quality_classifier, weak
from siltstone.llm.quality_classifier import classify, shape
from siltstone.llm.quality_rules import COUNTS, measured, quality_rules

CLEAN = "The river runs past the old mill and the people of the town walk there. "


def _clean(i, sentences=8):
    r = random.Random(i)
    return " ".join(" ".join(r.choice(["river", "mill", "town", "walk", "people", "stone", "water", "light", f"n{r.randrange(900)}"]) for _ in range(9)) + "." for _ in range(sentences))


def _brute(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


def test_counts_like_brute_force(docs_of):
    r = random.Random(3)
    rows = [(i, "".join(r.choice(["a ", "b ", "a b c d e ", "\n", "é# ", "\t", "a b\n", "$|", " ", "𝄞 "]) for _ in range(r.randrange(0, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, "a b c d e"), (204, "a a a a a a"), (205, "x " * 3000), (206, " ")]
    got = {x.doc_id: [x[c] for c in COUNTS[:1] + COUNTS[1:5]] for x in measured(docs_of(rows), "text", ["doc_id"]).collect()}
    for doc, text in rows:
        n, chars, symbols, dup, repeats = _brute(text)
        assert got[doc] == [n, chars, symbols, dup, repeats], (doc, text)


@pytest.fixture(scope="module")
def corpus(docs_of):
    rows = [(i, _clean(i)) for i in range(60)]
    rows += [(100 + i, " ".join(f"{w}%%%" for w in _clean(i).split())) for i in range(6)]
    rows += [(120 + i, " | ".join(_clean(i).split())) for i in range(6)]
    rows += [(140 + i, _clean(i).upper().replace(" ", "!! ")) for i in range(6)]
    rows += [(160, "too short"), (161, None), (162, "spam " * 200), (163, "")]
    return docs_of(rows)


def test_rules_keep_clean_and_drop_junk(corpus):
    kept = {r.doc_id: (r.kept, r.base_failed) for r in quality_rules(corpus).collect()}
    assert all(kept[i][0] for i in range(60))
    assert not any(kept[i][0] for i in kept if i >= 100)
    assert all(kept[i][1] for i in (160, 161, 162, 163)) and not any(kept[i][1] for i in range(60))


def test_rules_columns_and_empty(docs_of):
    df = docs_of([(1, _clean(1)), (1, _clean(1))]).withColumn("n_words", F.lit("old")).withColumn("other", F.lit(1))
    out = quality_rules(df).collect()
    assert len(out) == 2 and out[0].n_words == 72 and out[0].other == 1 and out[0] == out[1]
    assert quality_rules(docs_of([])).count() == 0


def _counted(spark, n, share, good, bad, seed=5):
    """Patterns of votes drawn with these accuracies; a tenth of the votes are abstentions."""
    r, codes = random.Random(seed), {}
    for _ in range(n):
        fine, code = r.random() < share, 0
        for g, b in zip(good, bad, strict=True):
            says = (r.random() < g) if fine else (r.random() >= b)
            code = code * 3 + (1 if r.random() < 0.1 else 2 if says else 0)
        codes[code] = codes.get(code, 0) + 1
    return spark.createDataFrame(sorted(codes.items()), "code int, n long")


def test_votes_recover_accuracies(spark):
    good, bad = (0.95, 0.9, 0.85, 0.8, 0.75, 0.6), (0.6, 0.7, 0.95, 0.8, 0.65, 0.9)
    model = weak.fit_votes(_counted(spark, 60000, 0.8, good, bad), 6)
    assert abs(model.good - 0.8) < 0.03
    assert np.abs(np.subtract(model.right_good, good)).max() < 0.03 and np.abs(np.subtract(model.right_bad, bad)).max() < 0.06


def test_votes_of_rare_alarms(spark):
    model = weak.fit_votes(_counted(spark, 20000, 0.5, (0.995,) * 5, (0.6,) * 5), 5)
    assert abs(model.good - 0.5) < 0.02
    assert all(abs(b - 0.6) < 0.05 for b in model.right_bad) and all(g >= 0.985 for g in model.right_good)
    empty = weak.fit_votes(spark.createDataFrame([], "code int, n long"), 5)
    assert len(empty.right_bad) == 5 and all(up >= 0 >= down for up, down in empty.weights())


def test_no_vote_counts_against_its_meaning(spark):
    model = weak.fit_votes(_counted(spark, 5000, 0.7, (0.9, 0.8, 0.3, 0.85), (0.8, 0.9, 0.3, 0.8)), 4)
    assert all(up >= -1e-9 and down <= 1e-9 for up, down in model.weights())


def test_one_bad_vote_is_outvoted(docs_of):
    rows = [(i, "The river is in the town and the mill is on the river. " + _clean(i)) for i in range(300)]
    rows += [(1000 + i, " ".join(f"{w}%%%" for w in _clean(i).split())) for i in range(30)]
    rows += [(2000, "Ordnung muss sein. " + re.sub(r"n\d+", "light", _clean(7))), (2001, "The mill is old and so is the town by the river in the hills.")]
    out = {r.doc_id: r.kept for r in quality_rules(docs_of(rows)).collect()}
    # One has no function words for its length, the other is short: one vote for bad each.
    assert all(out[i] for i in range(300)) and out[2000] and out[2001] and not any(out[1000 + i] for i in range(30))


def test_classifier(corpus, docs_of):
    out = {r.doc_id: r for r in classify(corpus).collect()}
    assert np.mean([out[i].kept for i in range(60)]) == 1.0
    junk = [i for i in out if 100 <= i < 160]
    assert np.mean([out[i].kept for i in junk]) < 0.2
    assert out[161].score == out[163].score == 0.0
    assert classify(docs_of([])).count() == 0
    assert classify(docs_of([(None, "a b"), (1, "a b"), (1, "a b")])).count() == 3


def test_shapes():
    assert [shape(w) for w in ("word", "Word", "WORD!!", "é", "x12", "a%%%", "An", "xYZ", "ab" * 50_000)] == ["a", "a", "A!!", "a", "a0", "a%%%", "a", "A", "a"]


def test_shares_and_long_texts(docs_of):
    assert quality_classifier.shares(Counter("a a a a b".split()), 5) == [4, 0, 0, 0, 0]
    assert quality_classifier.shares(Counter(["x"] * 3 + [f"w{i}" for i in range(7)]), 10) == [0, 3, 0, 0, 0]
    long = [(i, _clean(i)) for i in range(40)] + [(50, _clean(1, 4000)), (51, "x" * 200_000), (52, "spam " * 30_000), (52, "spam " * 30_000)]
    out = {r.doc_id: r.score for r in classify(docs_of(long).withColumn("score", F.lit("old")).withColumn("label", F.lit(1))).collect()}
    assert out[52] < 0.5 and all(0 <= x <= 1 for x in out.values())


def test_fit_scorer_empty():
    weights, offset = quality_classifier.fit_scorer([])
    assert not weights.any() and offset == 0.0
