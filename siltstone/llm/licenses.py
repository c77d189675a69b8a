"""Licence detection by TF-IDF cosine to templates, with directory inheritance.

Templates are notices, SPDX lines, headers and full licence texts. A file is
compared to each in every unit of its text: each line, each block of adjacent
lines, each comment with its blocks, and the whole text, by the cosine of
sparse TF-IDF vectors without ordinary words (term frequencies count as
1 + ln n): tokens join the templates' weights, and sums by (file, unit,
template) give the products. The best template at or above the threshold is
the file's own licence. Files without one inherit from the licence file in
their nearest ancestor directory: distinct directories are expanded to their
ancestors and joined to the directories that hold licence files, and the
deepest match wins.

Files and units are left out only where no template can reach the threshold.
By Cauchy-Schwarz a unit must share tokens that hold ``least`` squared of a
template's squared weight, so its file must have one of the template's telling
tokens; and at least that share of the unit's own squared weight must lie on
tokens that templates know. A unit that shares one word alone names no licence.

Cases: null texts and paths have no licence and inherit none (null path) or
by their path. A bare reservation of rights gives way to any licence. Ties
between licences go to the one with the larger sum over the file's units, then
to the name that sorts first; ties between licence files of a directory go to
the path that sorts first. Repeated rows are judged each. Empty tables work.
Columns named like the result's are replaced. Very long texts take time in
proportion to their length, very deep paths to their depth times the number of
distinct directories.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._work import matched, stored

TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0. Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal license."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "Copyright. All rights reserved. No part of this work may be reproduced without permission."),
    ("Proprietary", "All rights reserved."),
]
# Words of any English text, which say nothing here.
_ORDINARY = set(
    "a about after all also an and are as at be been best but by can de do first for from had has have he her here his how i if in into is it its just like made make me more most my new no not of on one only or our "
    "out over own she so some such take than that the their them then there these they this those time to too two up us very was way we well were what when where which while who will with would".split()
)
# SPDX identifiers by name; GPL and its kin have two forms each.
_SPDX = ["0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "ISC", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib"]
_SPDX_GNU = ["AGPL-3.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0"]
_BLANKS = "\\n[^A-Za-z0-9]*\\n"
_COMMENT = "[ \\t]*(?:#|//|/\\*|\\*|--|;|%)"


def _gnu_header(kind: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        f"without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details. "
        f"You should have received a copy of the GNU {kind} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


def _headers() -> list[tuple[str, str]]:
    """Headers as files carry them, also in one paragraph."""
    gnu = [("AGPL-3.0", "Affero General Public License", "3"), ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3")]
    gnu += [("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3")]
    found = []
    for name, kind, version in gnu:
        whole = _gnu_header(kind, version)
        found += [(name, whole), (name, whole[: whole.index(" This program is distributed")])]
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
    return found + [
        ("MPL-2.0", mpl + " If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
        ("Apache-2.0", apache + " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
        (
            "Apache-2.0",
            apache + " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License "
            'is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
            "See the License for the specific language governing permissions and limitations under the License.",
        ),
    ]


def _full_texts() -> list[tuple[str, str]]:
    """Full licence texts."""
    files = sorted(resources.files("siltstone.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name)
    return [(file.name.removesuffix(".txt"), file.read_text(encoding="utf-8")) for file in files]


TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in _SPDX]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}{end}") for name in _SPDX_GNU for end in ("", "-only", "-or-later")]
TEMPLATES += _headers()
TEMPLATES += _full_texts()
LEAST = 0.6
_TOKEN = "[^a-z0-9]+"
RESULT = ["own_license", "own_score", "license", "license_from"]


def template_weights(templates: list[tuple[str, str]]) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """Unit vectors (number, name, token, weight), idf by token, and the idf of any other token."""
    bags = [Counter(t for t in re.split(_TOKEN, text.lower()) if t and t not in _ORDINARY) for _, text in templates]
    df = Counter(t for bag in bags for t in bag)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for i, ((name, _), bag) in enumerate(zip(templates, bags, strict=True)):
        values = {t: (1 + math.log(n)) * idf[t] for t, n in bag.items()}
        norm = math.sqrt(sum(v * v for v in values.values()))
        rows += [(i, name, t, v / norm) for t, v in values.items()]
    return rows, idf, math.log(1 + len(bags)) + 1


def telling_tokens(rows: list[tuple[int, str, str, float]], idf: dict[str, float], least: float) -> list[str]:
    """Tokens of which a text must have one to reach a cosine of ``least`` to any template.

    Of each template the rarest tokens are taken until the others hold less
    than ``least`` squared of its squared weights.
    """
    bound, found, by_template = max(least - 1e-6, 0.0) ** 2, set(), {}
    for number, _, token, weight in rows:
        by_template.setdefault(number, []).append((-idf[token], token, weight))
    for tokens in by_template.values():
        tokens.sort()
        left = sum(t[2] ** 2 for t in tokens)
        for _, token, weight in tokens:
            if left < bound:
                break
            found.add(token)
            left -= weight**2
    return sorted(found)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; columns named in lambda functions are copied into them."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def units(text: Column) -> Column:
    """The distinct lines, blocks of adjacent lines, comments and their blocks, and the whole text."""

    def blocks(part: Column) -> Column:
        return F.split(part, _BLANKS)

    # A line that is no comment begins each part but perhaps the first; the rest of the part is one comment.
    parts = F.split(text, f"\\n(?!{_COMMENT})")
    runs = F.transform(parts, lambda part: F.when(part.rlike(f"^{_COMMENT}"), part).otherwise(F.regexp_replace(part, "^[^\\n]*\\n?", "")))
    return F.array_distinct(F.concat(F.split(text, "\n"), blocks(text), runs, F.flatten(F.transform(runs, blocks)), F.array(text)))


def own_licenses(files: DataFrame, text_col: str, keys: list[str], templates: list[tuple[str, str]], least: float) -> DataFrame:
    """Rows (keys, own_license, own_score) of the files with a recognised unit."""
    rows, idf, other = template_weights(templates)
    spark = files.sparkSession
    weights = spark.createDataFrame(rows, "number int, template string, token string, weight double")
    idfs = spark.createDataFrame(sorted(idf.items()), "token string, idf double")
    telling, known, ordinary = telling_tokens(rows, idf, least), sorted(idf), sorted(_ORDINARY | {""})
    # (1 + ln n)**2 <= 1.5 n, so the tokens that templates know hold at most 1.5 * (highest idf)**2 an occurrence,
    # and each distinct other token holds at least the square of its idf.
    room = 1.5 * (max(idf.values(), default=0.0) / other) ** 2 * (1 - least**2 + 1e-6)

    def split(part: Column) -> Column:
        return F.split(F.lower(part), _TOKEN)

    def reaches(tokens: Column) -> Column:
        others = F.array_distinct(F.filter(tokens, lambda t: ~t.isin(known) & ~t.isin(ordinary)))
        return F.size(others) * least**2 <= F.size(F.filter(tokens, lambda t: t.isin(known))) * room

    told = files.select(*keys, text_col).filter(F.exists(split(F.col(text_col)), lambda t: t.isin(telling)))
    chosen = told.select(
        *keys, F.posexplode(F.filter(units(F.col(text_col)), lambda u: _let(split(u), lambda t: F.exists(t, lambda x: x.isin(telling)) & reaches(t)))).alias("unit", "words")
    )
    unit = [*keys, "unit"]
    tokens = chosen.select(*unit, F.explode(split(F.col("words"))).alias("token")).filter(~F.col("token").isin(ordinary))
    tokens = tokens.groupBy(*unit, "token").agg(F.count("*").alias("tf")).join(F.broadcast(idfs), "token", "left")
    tokens = stored(tokens.select(*unit, "token", ((F.log("tf") + 1) * F.coalesce("idf", F.lit(other))).alias("value")), "tokens")
    norms = tokens.groupBy(*unit).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    dots = tokens.join(F.broadcast(weights), "token").groupBy(*unit, "number", "template").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"), F.count("*").alias("shared"))
    # One word alone, such as the German "mit", names no licence.
    dots = dots.filter("shared > 1").drop("shared")
    scored = dots.join(norms.hint("merge"), unit).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= least)
    by_unit = scored.groupBy(*unit, "template").agg(F.max("score").alias("score"))
    by_license = by_unit.groupBy(*keys, "template").agg(F.max("score").alias("score"), F.round(F.sum("score"), 4).alias("total"))
    best = F.min(F.struct((F.col("template") == "Proprietary").alias("p"), (-F.col("score")).alias("s"), (-F.col("total")).alias("n"), F.col("template").alias("t")))
    return by_license.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.t").alias("own_license"), (-F.col("b.s")).alias("own_score"))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def license_scan(
    files: DataFrame, is_license_file: Column, path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] | None = None, least: float = LEAST
) -> DataFrame:
    """The files, without their text, with own_license, own_score, license and license_from.

    ``license_from`` is ``header``, the directory of the licence file that is
    inherited, or null.
    """
    keep = [c for c in files.columns if c not in [*RESULT, text_col]]
    # Two hashes of 64 bits: equal rows share a key, others don't.
    keys = ["__u1", "__u2"]
    base = files.select(*keep, text_col).withColumns({"__u1": F.xxhash64(path_col, text_col), "__u2": F.xxhash64(F.lit(7), text_col, path_col)})
    own = stored(own_licenses(base, text_col, keys, templates or TEMPLATES, least), "own")
    light = base.select(*keep, *keys, is_license_file.alias("__is_file"), _directory(F.col(path_col)).alias("__dir"))
    light = stored(light.join(own.hint("merge"), keys, "left"), "files")
    offers = (
        light.filter("__is_file and own_license is not null and __dir is not null")
        .groupBy(F.col("__dir").alias("__up"))
        .agg(F.min_by("own_license", F.col(path_col)).alias("__offer"))
    )
    directories = stored(light.filter("__dir is not null").groupBy("__dir").agg(F.count("*").alias("__n")), "directories")
    parts = F.split(F.col("__dir"), "/")
    ups = directories.select("__dir", F.explode(F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("__up"))
    # All directories lie under the root, so ancestors are hot keys; both sides grow with the corpus.
    ups = stored(ups, "ancestors")
    asked = stored(ups.groupBy("__up").agg(F.count("*").alias("__m")).join(offers.hint("merge"), "__up"), "asked")
    nearest = (
        matched(ups, asked, ["__up"], "__m")
        .groupBy("__dir")
        .agg(F.max_by(F.struct("__offer", "__up"), F.when(F.col("__up") == "", 0).otherwise(F.size(F.split("__up", "/")))).alias("__near"))
    )
    nearest = stored(directories.join(nearest.hint("merge"), "__dir", "left"), "nearest")
    joined = matched(light.filter("__dir is not null"), nearest, ["__dir"], "__n").drop("__n")
    joined = joined.unionByName(light.filter("__dir is null").withColumn("__near", F.lit(None).cast(nearest.schema["__near"].dataType)))
    return joined.select(
        *keep,
        "own_license",
        "own_score",
        F.coalesce("own_license", "__near.__offer").alias("license"),
        F.when(F.col("own_license").isNotNull(), F.lit("header")).otherwise(F.col("__near.__up")).alias("license_from"),
    )
