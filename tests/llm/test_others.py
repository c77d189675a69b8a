import math
import random
import re
import textwrap
import zlib
from datetime import datetime
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import langid, licenses, mixing, queries
from siltstone.llm.langid import LanguageModel, Predictor, identify
from siltstone.llm.licenses import license_scan
from siltstone.llm.mixing import mix, targets
from siltstone.llm.packing import CapacityTree, Encoder, pack, pack_lengths
from siltstone.llm.url_filters import url_filter

PATH = public_tokenizers.path("word_bpe_49k.json")


# Packing


@given(st.lists(st.integers(1, 300), max_size=60))
@settings(max_examples=200, deadline=None)
def test_lengths_are_packed_whole(lengths):
    sequences = pack_lengths(lengths, 64, 2)
    pieces = sorted((d, s, n) for seq in sequences for d, s, n in seq)
    for doc, length in enumerate(lengths):
        at = 0
        for _, start, n in [p for p in pieces if p[0] == doc]:
            assert start == at and n > 0
            at += n
        assert at == length
    sizes = [sum(n for _, _, n in seq) for seq in sequences]
    assert all(0 < n <= 64 for n in sizes)
    assert all(64 - n <= 2 or n & (n - 1) == 0 for n in sizes)


@given(st.lists(st.integers(1, 64), max_size=40), st.integers(1, 64))
@settings(max_examples=200, deadline=None)
def test_tree_finds_tightest(capacities, length):
    tree = CapacityTree(64)
    for i, c in enumerate(capacities):
        tree.put(c, i)
    fitting = [c for c in capacities if c >= length]
    found = tree.take(length)
    assert (found[0] if found else None) == (min(fitting) if fitting else None)


def test_pack_round_trip(docs_of):
    rows = [(1, "hello world. " * 3000), (2, None), (3, ""), (4, "Ünïcode, ÉÈ <|endoftext|> x" * 50), (5, "z" * 5000), (5, "z" * 5000), (None, "a b"), *[(10 + i, "word " * i) for i in range(60)]]
    pieces = pack(docs_of(rows).withColumn("start", F.lit("x")).withColumn("ids", F.lit(1)), PATH).collect()
    tokenizer = Encoder(PATH).tokenizer
    whole = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert len(p.ids) == 4 * p.length
        whole.setdefault(p.sequence_id, []).append(p)
    for parts in whole.values():
        assert [p.offset for p in parts] == list(np.cumsum([0] + [p.length for p in parts])[:-1])
    for doc, text in rows:
        want = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        mine = sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start)
        got = b"".join(p.ids for p in mine)
        assert len(got) % len(want) == 0 and sum(p.length for p in mine) == len(got) // 4 and mine[0].doc_tokens == len(want) // 4
        if doc != 5:
            assert got == want
    assert pack(docs_of([]), PATH).count() == 0


@given(st.one_of(st.text(max_size=60), st.text(alphabet="aAéÉßẞ.,' \n\t\x0b́Σσ1!<|>İ", max_size=60), st.text(alphabet="etaoinshrdlu THEAND'stvm.,1²ªÿ×÷’—", max_size=80)))
@settings(max_examples=400, deadline=None)
def test_runs_tokenise_alike(text):
    cache = _cache()
    assert cache.encode([text])[0] == np.array(cache.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def _cache(made=[]):  # noqa: B006
    if not made:
        made.append(Encoder(PATH))
    return made[0]


def test_random_words_tokenise_alike():
    r, coder = random.Random(8), _cache()
    letters = "eeettaaoiinnsshrrdlucmfwypvbgkqjxz" + "éèàüßñ" + "'.,-!?"
    texts = [" ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 14))) for _ in range(400)) for _ in range(60)] + ["x" * 60_000, "ab" * 300, "\0 a\0", "a\x85b\xa0c\x1fd"]
    want = [np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert coder.fast is not None and coder.encode(texts) == want


def test_special_tokens_keep_their_letters():
    cache = Encoder(PATH)
    texts = ["a <|EndOfText|> b", "a <|endoftext|> b", "A <|STARTOFTEXT|>. b\nC", "<|", "x <| y"]
    want = [np.array(cache.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert cache.encode(texts) == want


# Mixing


def test_targets():
    assert targets([]) == []
    got = targets([100, 100, 100])
    assert got == [200.0, 500 / 3 - 250 / 3 + 83 + 1 / 3, 450 - 200 - 500 / 3] or sum(got) == pytest.approx(450)
    assert got[0] == 200 and got[1] == pytest.approx(500 / 3) and got[2] == pytest.approx(250 / 3)
    assert sum(targets([7, 1, 900, 0, 55])) == pytest.approx(1.5 * 963)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_mix_meets_targets(docs_of, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(mixing, "BIN_DOCS", 7)
    r = random.Random(2)
    rows = [(i, "w " * (r.randrange(1, 40) if i % 3 else 12), "en", r.choice(["b", "a", "ü", None, "c", "a"])) for i in range(900)]
    rows += [(1000, None, "en", "a"), (1001, "", "en", "empty"), (1002, "x y", "en", None)]
    docs = docs_of(rows)
    out = mix(docs, carry=["doc_id", "source"]).collect()
    assert len(out) == len(rows)
    order = sorted({x[3] for x in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(len((x[1] or "").split()) for x in rows if x[3] == s) for s in order}
    want = dict(zip(order, targets([sizes[s] for s in order]), strict=True))
    for s in order:
        mine = [x for x in out if x.source == s]
        assert all(x.source_size == sizes[s] and x.target == pytest.approx(want[s]) and 0 <= x.copies <= 2 for x in mine)
        assert abs(sum(x.copies * x.size for x in mine) - want[s]) <= 0.01 * want[s] + 12
    again = {x.doc_id: x.copies for x in mix(docs.repartition(7), carry=["doc_id"]).collect()}
    assert again == {x.doc_id: x.copies for x in out}


def test_mix_like_brute_force(docs_of):
    """Rates by bisection of each source's dual, rounding and ranks written apart from the operator."""
    r = random.Random(9)
    rows = [(i, "w " * (r.randrange(1, 30) if i % 2 else 9), "en", r.choice(["a", "b", "b", "c", None])) for i in range(700)]
    docs = docs_of(rows)
    out = {x.doc_id: x for x in mix(docs, carry=["doc_id", "source"]).collect()}
    draws = {x[0]: x[1] for x in docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id")).collect()}
    order = sorted({x[3] for x in rows}, key=lambda s: (s is None, s or ""))
    size = {i: len(t.split()) for i, t, _, _ in rows}
    goals = dict(zip(order, targets([sum(size[x[0]] for x in rows if x[3] == s) for s in order]), strict=True))
    for s in order:
        strata: dict = {}
        for i, _, _, source in rows:
            if source == s:
                strata.setdefault(size[i], []).append(i)
        total, n = sum(k * len(v) for k, v in strata.items()), sum(map(len, strata.values()))
        rate = lambda lam, k: 2 / (1 + math.exp(-max(-500.0, min(500.0, lam * k / max(1.0, total / n)))))  # noqa: E731, B023
        low, high = -60.0, 60.0
        for _ in range(200):
            mid = (low + high) / 2
            if sum(k * len(v) * rate(mid, k) for k, v in strata.items()) > goals[s]:
                high = mid
            else:
                low = mid
        owed = 0.0
        for k in sorted(strata, reverse=True):
            ids = sorted(strata[k], key=lambda i: draws[i])
            f = 2.0 if goals[s] >= 2 * total * (1 - 1e-12) else rate(low, k)
            owed += f * len(ids) * k
            copies = min(max(round(owed / k), min(math.floor(f), 2) * len(ids)), min(math.ceil(f), 2) * len(ids))
            owed -= copies * k
            base, extra = copies // len(ids), copies % len(ids)
            assert [out[i].copies for i in ids] == [base + (at < extra) for at in range(len(ids))], (s, k)


def test_mix_long_texts_and_null_ids(docs_of):
    rows = [(None, "a b c", "en", "x")] * 40 + [(i, "a b c", "en", "x") for i in range(40)] + [(900, "w " * 50_000, "en", "x"), (901, "y" * 100_000, "en", "z")]
    out = mix(docs_of(rows), carry=["doc_id"]).collect()
    assert len(out) == len(rows) and len({x.copies for x in out if x.doc_id is None}) == 1
    assert {x.size for x in out if x.doc_id in (900, 901)} == {50_000, 1} and all(0 <= x.copies <= 2 for x in out)


def test_mix_edges(docs_of):
    assert mix(docs_of([])).count() == 0
    same = mix(docs_of([(1, "a b c")] * 5 + [(None, "a b")]).withColumn("size", F.lit("x")).withColumn("k", F.lit(1))).collect()
    assert len(same) == 6 and len({x.copies for x in same if x.doc_id == 1}) == 1


# Languages


def test_backoff():
    model = LanguageModel([("en", "the", 50), ("en", "thing", 5), ("de", "der", 50), ("de", "ding", 5), ("xx", "qqq", 9)])
    predict = Predictor(model).predict
    assert predict("the thing")[0] == "en" and predict("DER")[0] == "de"
    assert predict("things thinging")[0] == "en" and predict("dinge")[0] == "de"
    assert predict("qqqqq")[0] == "xx"
    assert predict(None) == predict("") == predict("12 !?") == predict("² Ⅷ _") == ("und", 0.0)
    assert 0 < predict("zzz")[1] <= 1
    assert Predictor(LanguageModel([])).predict("word") == ("und", 0.0)


def test_held_out_accuracy(spark, docs_of):
    words = {"en": "the and river stone walking", "de": "und der fluss steine gehend", "fr": "le et rivière pierre marchant"}
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(words[lang].split()) + r.choice(["", "s", "en"]) for _ in range(12)), lang) for i, lang in ((i, r.choice(list(words))) for i in range(300))]
    rows += [(900, None, "en"), (901, "123", "de"), (902, "der fluss", None)]
    docs = docs_of(rows)
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    out = {x.doc_id: x for x in identify(docs, fold != 2).collect()}
    held = [(i, lang) for i, _, lang in rows[:300] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 40 and np.mean([out[i].lang_pred == lang for i, lang in held]) > 0.95
    assert out[900].lang_pred == out[901].lang_pred == "und" and out[902].lang_pred == "de"
    assert {x.lang_pred for x in identify(docs, F.lit(False)).collect()} == {"und"}
    assert identify(docs_of([]), F.lit(True)).count() == 0


def test_languages_of_any_size(docs_of, monkeypatch):
    """A language with two documents is learnt next to one with hundreds; long texts, ties and clashing columns."""
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 50)
    rows = [(i, "the river and the stone " * 3, "en") for i in range(600)] + [(700 + i, "der fluss und der stein", "de") for i in range(2)]
    rows += [(800, "fluss " * 60_000, None), (801, "zzz", "en"), (802, "q" * 100_000, None)]
    docs = docs_of(rows).withColumn("score", F.lit("x")).withColumn("n", F.lit(1)).withColumn("draw", F.lit(2)).withColumn("word", F.lit("w"))
    out = {x.doc_id: x for x in identify(docs, F.lit(True)).collect()}
    assert out[700].lang_pred == out[701].lang_pred == out[800].lang_pred == "de" and out[5].lang_pred == "en" and 0 <= out[802].score <= 1


def test_languages_like_brute_force(spark, docs_of):
    """Scores recomputed word by word from counts of the whole training fold."""
    r = random.Random(3)
    vocabulary = {lang: ["".join(r.choice(letters) for _ in range(r.randrange(2, 7))) for _ in range(60)] for lang, letters in (("a", "abcde"), ("b", "cdefg"), ("c", "efghi"))}
    rows = [(i, " ".join(r.choice(vocabulary[lang]) for _ in range(r.randrange(1, 9))), lang) for i, lang in ((i, r.choice("abc")) for i in range(200))]
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    out = {x.doc_id: x for x in identify(docs_of(rows), fold != 2).collect()}
    counts, grams = {}, {}
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            for w in text.split():
                counts.setdefault(w, dict.fromkeys("abc", 0))[lang] += 1
    for w, by in counts.items():
        for n in range(1, 6):
            for g in [f"_{w}_"[k : k + n] for k in range(len(w) + 3 - n)]:
                cell = grams.setdefault(n, {}).setdefault(g, dict.fromkeys("abc", 0))
                for lang in "abc":
                    cell[lang] += by[lang]

    def logs(table, key, lang):
        return math.log((table[key][lang] + 0.1) / (sum(x[lang] for x in table.values()) + 0.1 * len(table)))

    for i, text, _ in rows[:80]:
        total = dict.fromkeys("abc", 0.0)
        for w in text.split():
            for lang in "abc":
                if w in counts:
                    total[lang] += logs(counts, w, lang)
                    continue
                for n in range(5, 0, -1):
                    known = [logs(grams[n], g, lang) for g in [f"_{w}_"[k : k + n] for k in range(len(w) + 3 - n)] if g in grams.get(n, {})]
                    if known:
                        total[lang] += sum(known) / len(known)
                        break
        best = max(sorted(total), key=lambda x: total[x])
        assert out[i].lang_pred == best and out[i].score == pytest.approx(1 / sum(math.exp(v - total[best]) for v in total.values()), abs=1e-3)


# Licences


def test_license_inheritance(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/x.py", "code"), ("a/b/y.py", "more\n# Licensed under the Apache License, Version 2.0.\n"), ("a/b/c/z.py", None),
        ("q/w.py", "no notice"), ("LICENSE", "This work is licensed under the GNU General Public License, version 3."), ("a/b/LICENSE", "Copyright of nobody, see elsewhere for many other words."),
        (None, "Licensed under CC BY-NC 4.0."), (None, None), ("a/x.py", "code"), ("l/long.py", "filler words\n" * 3000 + "Licensed under CC BY-NC 4.0."),
    ]
    files = spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit("old")).withColumn("line", F.lit(1))
    out = license_scan(files, F.col("path").rlike("(^|/)LICENSE$")).collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        got.setdefault(r.path, set()).add((r.license, r.license_from))
    assert got["a/x.py"] == {("MIT", "a")} and got["a/b/y.py"] == {("Apache-2.0", "header")} and got["a/b/c/z.py"] == {("MIT", "a")}
    assert got["q/w.py"] == {("GPL-3.0", "")} and got["a/b/LICENSE"] == {("MIT", "a")} and got["l/long.py"] == {("CC-BY-NC-4.0", "header")}
    assert got[None] == {("CC-BY-NC-4.0", "header"), (None, None)}
    assert license_scan(files.limit(0), F.lit(False)).count() == 0


def _units(text):
    """Lines, blocks, comments, their blocks and the whole text, written apart from the operator."""
    lines, found = text.split("\n"), {text}
    comment = re.compile(r"[ \t]*(?:#|//|/\*|\*|--|;|%)")
    runs, now = [], []
    for line in lines:
        if comment.match(line):
            now.append(line)
        else:
            runs.append("\n".join(now))
            now = []
    runs.append("\n".join(now))
    for part in [text, *runs]:
        found.update([part, *re.split(r"\n[^A-Za-z0-9]*\n", part)])
    return found | set(lines)


def _best_license(text, weights, idf, other, least):
    """(licence, score) by comparing every unit to every template."""
    best: dict = {}
    totals: dict = {}
    for unit in _units(text):
        bag: dict = {}
        for t in re.split("[^a-z0-9]+", unit.lower()):
            if t and t not in licenses._ORDINARY:
                bag[t] = bag.get(t, 0) + 1
        values = {t: (1 + math.log(n)) * idf.get(t, other) for t, n in bag.items()}
        norm = math.sqrt(sum(v * v for v in values.values()))
        dots: dict = {}
        for t, v in values.items():
            for number, name, w in weights.get(t, ()):
                d, k = dots.get((number, name), (0.0, 0))
                dots[number, name] = d + v * w, k + 1
        here: dict = {}
        for (_, name), (d, k) in dots.items():
            if k > 1 and round(d / norm, 6) >= least:
                here[name] = max(here.get(name, 0), round(d / norm, 6))
        for name, score in here.items():
            best[name] = max(best.get(name, 0), score)
            totals[name] = totals.get(name, 0) + score
    ranked = sorted(best, key=lambda n: (n == "Proprietary", -best[n], -round(totals[n], 4), n))
    return (ranked[0], best[ranked[0]]) if ranked else (None, None)


def _weights():
    rows, idf, other = licenses.template_weights(licenses.TEMPLATES)
    weights: dict = {}
    for number, name, t, w in rows:
        weights.setdefault(t, []).append((number, name, w))
    return weights, idf, other


def test_cosine_like_brute_force(spark):
    texts = ["Licensed under the Apache License, version 2.0, or the MIT License", "license mit license", "x = 1\n# Released under MIT\n#\n# license terms of the GNU public license\ny", "mit der License", ""]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    for least in (0.3, licenses.LEAST):
        got = {r.path: (r.own_license, r.own_score) for r in license_scan(files, F.lit(False), least=least).collect()}
        for i, text in enumerate(texts):
            name, score = _best_license(text, *_weights(), least)
            assert got[str(i)][0] == name and got[str(i)][1] == (score if score is None else pytest.approx(score, abs=2e-6)), text


def test_whole_table_like_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    if not Path(folder).is_dir():
        pytest.skip("no tables here")
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    extra = [(Path(licenses.__file__).parent / "license_texts" / f"{n}.txt").read_text() for n in ("MIT", "Apache-2.0", "ISC", "GPL-2.0")]
    own = {d.doc_id: _best_license(d.text or "", *_weights(), licenses.LEAST) for d in docs}
    got = {r.doc_id: r for r in queries.op2_license_scan(spark, folder).collect()}
    offers: dict = {}
    for d in sorted(docs, key=lambda d: got[d.doc_id].path):
        if d.doc_id % 10 == 0 and own[d.doc_id][0]:
            offers.setdefault(got[d.doc_id].path.rsplit("/", 1)[0], own[d.doc_id][0])
    for d in docs:
        up, r = got[d.doc_id].path, got[d.doc_id]
        assert (r.own_license, r.own_score) == own[d.doc_id]
        while up and not r.own_license:
            up = up.rsplit("/", 1)[0] if "/" in up else ""
            if up in offers:
                break
        assert (r.license, r.license_from) == ((r.own_license, "header") if r.own_license else (offers.get(up), up if up in offers else None))
    assert sum(name is not None for name, _ in own.values()) >= 3 and all(_best_license(t, *_weights(), licenses.LEAST)[0] for t in extra)


def test_usual_headers(spark):
    want = {
        "# SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "/* SPDX-License-Identifier: GPL-3.0-only */": "GPL-3.0",
        "# SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1", "# SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "# SPDX-License-Identifier: MPL-2.0": "MPL-2.0",
        "# SPDX-License-Identifier: ISC": "ISC", "-- SPDX-License-Identifier: CC0-1.0": "CC0-1.0", "# SPDX-License-Identifier: AGPL-3.0-or-later": "AGPL-3.0",
        "# Licensed under the MIT License.": "MIT", "# Released under the Apache License 2.0": "Apache-2.0", "# Copyright (c) 2020 Jo Doe.\n# All rights reserved.": "Proprietary",
        "# This work is licensed under the GNU General Public License, version 2.": "GPL-2.0", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "# " + licenses._gnu_header("Lesser General Public License", "2.1"): "LGPL-2.1", "# " + licenses._gnu_header("Affero General Public License", "3"): "AGPL-3.0",
        "the cat and the dog went to the market to buy bread": None, "a/" * 400 + "license": None,
    }
    rows = [("/".join(["d"] * 300) + f"/f{i}", f"{header}\n\nimport os\nprint(os.name)\n") for i, header in enumerate(want)]
    got = {r.path.rsplit("/f", 1)[1]: r.own_license for r in license_scan(spark.createDataFrame(rows, "path string, text string"), F.lit(False)).collect()}
    assert [got[str(i)] for i in range(len(want))] == list(want.values())


def test_license_whole_headers_and_files(spark):
    def text(name):
        return (Path(licenses.__file__).parent / "license_texts" / f"{name}.txt").read_text()

    def wrapped(body, mark, width=60):
        return "\n".join(f"{mark} {x}" for x in textwrap.wrap(body, width)) + "\nimport os\nprint(os.name)\n"

    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    bsd = "Copyright (c) 2020, Some Body. All rights reserved. " + " ".join(text("BSD-3-Clause").split())
    want = {
        "rights": ("All rights reserved.", "Proprietary"), "among": ("some words\nmore words\nAll rights reserved.\nwords again", "Proprietary"),
        "gpl": (wrapped(gpl, "#"), "GPL-3.0"), "gpl2": (wrapped(gpl.replace("version 3", "version 2"), "#"), "GPL-2.0"), "mpl": (wrapped(mpl, " *"), "MPL-2.0"), "bsd": (wrapped(bsd, "//"), "BSD-3-Clause"),
        "spdx": ("# SPDX-License-Identifier: GPL-3.0-or-later\nx = 1", "GPL-3.0"), "spdx2": ("/* SPDX-License-Identifier: MIT */", "MIT"),
        "both": ("# All rights reserved.\n\n" + wrapped("Licensed under the Apache License, Version 2.0.", "#"), "Apache-2.0"), "none": ("the cat was on all of it and is to be at home", None), "null": (None, None),
    }
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "ISC"):
        want[f"full {name}"] = text(name), name
        body = text(name).split("\n")
        want[f"tail {name}"] = "\n".join(body[len(body) // 3 :]) if len(body) > 30 else text(name), name
    files = spark.createDataFrame([(k, t) for k, (t, _) in want.items()], "path string, text string")
    got = {r.path: r.own_license for r in license_scan(files, F.lit(False)).collect()}
    assert got == {k: name for k, (_, name) in want.items()}


def test_telling_tokens_lose_nothing():
    rows, idf, other = licenses.template_weights(licenses.TEMPLATES)
    telling = set(licenses.telling_tokens(rows, idf, licenses.LEAST))
    left = {}
    for number, _, token, weight in rows:
        if token not in telling:
            left[number] = left.get(number, 0.0) + weight * weight
    assert max(left.values()) < licenses.LEAST**2
    assert set(licenses.telling_tokens(rows, idf, 0.0)) == set(idf)


# URL lists


def test_entries_hold_in_their_time(spark):
    day = lambda m, d=1: datetime(2024, m, d)
    entries = [
        ("domain", "bad.com", "block", day(2)), ("domain", "bad.com", "remove", day(4)), ("domain", "BAD.com", "block", day(6)),
        ("host", "good.bad.com", "allow", day(1)), ("prefix", "mixed.org/x", "block", day(1)), ("prefix", "mixed.org/x/ok", "allow", day(1)),
        ("domain", "tie.net", "remove", day(1)), ("domain", "tie.net", "block", day(1)), ("domain", None, "block", day(1)), ("other", "mixed.org", "block", day(1)),
    ]
    captures = [
        (1, "http://bad.com/", day(1, 31)), (2, "http://bad.com/", day(2)), (3, "https://u@a.bad.com:80/p?q", day(3)), (4, "http://bad.com", day(5)), (5, "http://x.bad.com/#f", day(7)),
        (6, "http://good.bad.com/", day(3)), (7, "http://mixed.org/x/y", day(2)), (8, "http://mixed.org/x/ok/z", day(2)), (9, "http://mixed.org/xx", day(2)), (10, "http://tie.net", day(2)),
        (11, None, day(2)), (12, "not a url", day(2)), (13, "http://bad.com/", None), (14, "http://notbad.com/", day(3)), (2, "http://bad.com/", day(2)),
    ]
    e = spark.createDataFrame(entries, "kind string, value string, action string, listed_at timestamp")
    c = spark.createDataFrame(captures, "page_id int, url string, fetched_at timestamp").withColumn("month", F.lit("x")).withColumn("action", F.lit("old"))
    out = url_filter(c, e).collect()
    assert len(out) == len(captures) and all(r.month == "x" for r in out)
    action = {r.page_id: r.action for r in out}
    assert action == {1: "pass", 2: "block", 3: "block", 4: "pass", 5: "block", 6: "allow", 7: "block", 8: "allow", 9: "pass", 10: "block", 11: "pass", 12: "pass", 13: "pass", 14: "pass"}
    assert {r.action for r in url_filter(c, e.limit(0)).collect()} == {"pass"}
    # Wild dates, several changes in a day, and a very long URL.
    wild = spark.createDataFrame([(1, "http://bad.com/", datetime(9998, 1, 1)), (2, "http://bad.com/", datetime(1900, 1, 1)), (3, "http://bad.com/" + "a/" * 20_000, datetime(2024, 2, 2, 11)), (4, "http://bad.com/", datetime(2024, 2, 2, 9))], c.select("page_id", "url", "fetched_at").schema)
    hours = spark.createDataFrame([("domain", "bad.com", a, datetime(2024, 2, 2, h)) for h, a in ((8, "block"), (10, "allow"), (12, "remove"), (14, "block"))], e.schema)
    assert {r.page_id: r.action for r in url_filter(wild, hours).collect()} == {1: "block", 2: "pass", 3: "allow", 4: "block"}
    assert url_filter(c.limit(0), e).count() == 0


def test_many_changes_like_brute_force(spark):
    random.seed(4)
    at = lambda: datetime(2023 + random.randrange(2), random.randint(1, 12), random.randint(1, 28), random.randrange(24))
    entries = [("domain", random.choice(["a.com", "b.a.com"]), random.choice(["block", "allow", "remove"]), at()) for _ in range(60)]
    entries = [("domain", value, action, since) for (value, since), action in {(v, t): a for _, v, a, t in entries}.items()]
    captures = [(i, random.choice(["http://a.com/", "http://b.a.com/x"]), at()) for i in range(300)]
    e = spark.createDataFrame(entries, "kind string, value string, action string, listed_at timestamp")
    c = spark.createDataFrame(captures, "page_id int, url string, fetched_at timestamp")
    found = {r.page_id: r.action for r in url_filter(c, e).collect()}
    for i, url, when in captures:
        verdict = "pass"
        for value in ("b.a.com", "a.com") if "b." in url else ("a.com",):
            active = max((t, a) for _, v, a, t in [*entries, ("", value, "remove", datetime(1, 1, 1))] if v == value and t <= when)[1]
            if active != "remove":
                verdict = active
                break
        assert found[i] == verdict
