import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import _bloom, _trie, ngram_join
from siltstone.llm._components import components
from siltstone.llm.exact_dedup import exact_dedup
from siltstone.llm.line_dedup import line_dedup
from siltstone.llm.ngram_join import keep_one, near_groups

WORDS = [f"word{i}" for i in range(400)]


def _text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def test_bloom_misses_nothing(spark):
    keys = spark.range(500).select((F.col("id") % 300).alias("k"), F.monotonically_increasing_id().alias("u")).repartition(5)
    bits = _bloom.bits_for(500)
    twice = _bloom.repeated(keys, "k", "u", bits)
    flags = {r.k: r.maybe for r in _bloom.flagged(keys, "k", twice, bits, "maybe").collect()}
    assert all(flags[k] for k in range(200))
    assert sum(flags[k] for k in range(200, 300)) < 20
    some = _bloom.bloom(keys.filter("k < 50"), "k", bits)
    flags = {r.k: r.maybe for r in _bloom.flagged(keys, "k", some, bits, "maybe").collect()}
    assert all(flags[k] for k in range(50)) and sum(flags[k] for k in range(50, 300)) < 20
    assert _bloom.bits_for(0) == _bloom.MIN_BITS and _bloom.bits_for(10**12) == _bloom.MAX_BITS and _bloom.slices(0) == 1 and _bloom.slices(10**9) > 100


def test_exact_in_slices(docs_of, monkeypatch):
    rows = [(i, "same" if i % 3 == 0 else f"text {i // 2}", "en") for i in range(400)]
    whole = sorted(map(tuple, exact_dedup(docs_of(rows)).collect()))
    monkeypatch.setattr(_bloom, "MAX_BITS", 1 << 11)
    monkeypatch.setattr(_bloom, "MIN_BITS", 1 << 11)
    assert _bloom.slices(400) > 3
    assert sorted(map(tuple, exact_dedup(docs_of(rows).repartition(3)).collect())) == whole


def test_exact_copies(docs_of):
    rows = [(5, "a b"), (3, "a  b"), (4, "ab"), (9, "a\tb "), (1, None), (2, " \n"), (7, "é"), (8, "x"), (8, "x"), (None, "x"), (6, "Ab")]
    out = exact_dedup(docs_of(rows)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.text_sha256, []).append(r)
    ab = by[hashlib.sha256(b"ab").hexdigest()]
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in ab} == {(5, 3, 4, False), (3, 3, 4, True), (4, 3, 4, False), (9, 3, 4, False)}
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert {(r.doc_id, r.keep_id, r.kept) for r in empty} == {(1, 2, False), (2, 2, True)}
    repeated = by[hashlib.sha256(b"x").hexdigest()]
    assert [r.keep_id for r in repeated] == [8, 8, 8] and sum(r.kept for r in repeated) == 1
    assert all(r.kept and r.keep_id == r.doc_id for t in ("é", "Ab") for r in by[hashlib.sha256(t.encode()).hexdigest()])


def test_exact_empty_and_clashing_columns(docs_of):
    assert exact_dedup(docs_of([])).count() == 0
    clash = docs_of([(1, "a"), (2, "a")]).withColumn("keep_id", F.lit("x")).withColumn("sha", F.lit(1)).withColumn("uid", F.lit(1))
    assert sorted(r.kept for r in exact_dedup(clash).collect()) == [False, True]


def _lines_brute(rows):
    seen, gone = {}, {}
    windows = []
    for doc, text in rows:
        lines = [x.strip(" \t\n\x0b\x0c\r") for x in (text or "").split("\n")]
        windows += [(doc, i, tuple(lines[i : i + 3])) for i in range(len(lines) - 2) if any(lines[i : i + 3])] if text is not None else []
    for doc, i, w in sorted(windows):
        if w in seen:
            gone.setdefault(doc, set()).update((i, i + 1, i + 2))
        seen[w] = 1
    return {d: t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in rows}


def test_lines_like_brute_force(docs_of):
    r = random.Random(4)
    rows = [(i, "\n".join(r.choice(["alpha", "beta ", " beta", "gamma", "", "delta"]) for _ in range(r.randrange(0, 12)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "a\nb\nc"), (104, "z\na\nb\nc\ny"), (105, "a\nb\nc")]
    out = {x.doc_id: x for x in line_dedup(docs_of(rows)).collect()}
    want = _lines_brute(rows)
    assert {k: x.text for k, x in out.items()} == want
    assert out[105].text == "" and out[105].n_removed == 3 and out[104].text == "z\ny"


def test_lines_repeated_rows_and_clashes(docs_of):
    df = docs_of([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc")]).withColumn("line", F.lit(1)).withColumn("h", F.lit(2)).withColumn("th", F.lit(3))
    out = line_dedup(df).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, ""), (1, "a\nb\nc"), (1, "a\nb\nc")]
    assert all((r.line, r.h, r.th) == (1, 2, 3) for r in out)
    assert line_dedup(docs_of([])).count() == 0


def _groups_brute(rows):
    sets, parent = {}, {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        parent[doc] = doc

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def _near_rows():
    r = random.Random(7)
    rows, n = [], 0
    for family in range(12):
        base = _text(family, r.choice([3, 5, 6, 8, 30, 120, 400])).split()
        for _ in range(r.choice([1, 2, 5, 30])):
            copy = list(base)
            for _ in range(r.randrange(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(WORDS)
            rows.append((n, " ".join(copy).upper() if r.random() < 0.2 else " ".join(copy)))
            n += 1
    passage = _text("shared", 40)
    rows += [(n + i, passage + " " + _text(f"own{i}", 9 + i % 5)) for i in range(40)]
    n += 40
    # A chain in which only neighbours link.
    chain = _text("chain", 60).split()
    rows += [(n + i, " ".join(chain[2 * i :] + _text(f"c{i}", 2 * i).split())) for i in range(12)]
    n += 12
    return [*rows, (n, None), (n + 1, ""), (n + 2, "one"), (n + 3, " ONE\n"), (n + 4, "a b c d"), (n + 5, "a b c d e"), (n + 6, "x y z w v u t"), (n + 7, "x y z w v u")]


@pytest.mark.parametrize("block", [2000, 4])
def test_near_groups_like_brute_force(docs_of, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rows = _near_rows()
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(docs_of(rows)).collect()}
    assert out == _groups_brute(rows)


def test_keep_one(docs_of):
    text = _text("k", 50)
    rows = [(4, text), (2, text.upper()), (9, text + " more"), (2, text.upper()), (7, _text("other", 50)), (1, None), (3, ""), (3, ""), (None, text)]
    kept = keep_one(docs_of(rows).withColumn("f", F.lit(0)).withColumn("n", F.lit("x")))
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(1, ""), (2, text.upper()), (3, ""), (3, ""), (7, _text("other", 50))])
    assert keep_one(docs_of([])).count() == 0


def test_trie_skips_nothing():
    r = random.Random(1)
    for _ in range(60):
        base = sorted(r.sample(range(40), 20))
        sets = [sorted(set(base) ^ set(r.sample(range(40), r.randrange(0, 8)))) for _ in range(25)]
        sizes = [len(s) + r.randrange(0, 3) for s in sets]
        found = _trie.trie_components(sizes, sets)
        union = _trie.Union(25)
        for i in range(25):
            for j in range(i):
                if _trie.linked(len(set(sets[i]) & set(sets[j])), sizes[i], sizes[j]):
                    union.join(i, j)
        assert found == [union.find(i) for i in range(25)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (100, 60), (60, 70)]
    out = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 70: 50, 100: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
