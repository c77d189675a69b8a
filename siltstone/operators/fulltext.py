"""Full-text search: boolean, phrase and prefix matching, BM25 and snippets.

A query touches the corpus in two scans without shuffling documents: each
document's tokens are matched in place, the first scan aggregates the corpus
statistics of the query's phrases to one row, the second scores and keeps the
best. An inverted index (``postings``, kept in step with writes by
``update_postings``) is there for many queries over one corpus.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.scalars import let

# BM25 parameters and limits of the search.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
DEFAULT_LIMIT, MAX_LIMIT = 15, 100
SNIPPET_TOKENS = 32

_SEPARATORS = "[^\\p{L}\\p{N}]+"


def _marked_letters() -> tuple[str, str]:
    """Letters with one or more marks below U+2000, and the letters without them."""
    pairs = []
    for code in range(0xC0, 0x2000):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _BARE = _marked_letters()


def fold_marks(text: Column) -> Column:
    """The text without diacritics: of letters that have them, and standing alone."""
    return F.when(text.rlike("[^\\x00-\\x7f]"), F.regexp_replace(F.translate(text, _MARKED, _BARE), "\\p{Mn}+", "")).otherwise(text)


def spaced(text: Column, fold: bool = True) -> Column:
    """Lower-case runs of letters and digits, each between two blanks of its own."""
    low = F.lower(fold_marks(text) if fold else text)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, _SEPARATORS, "  ")), F.lit(" "))


def tokens(text: Column, fold: bool = True) -> Column:
    """Lower-case runs of letters and digits; ``fold`` removes diacritics, as for files (chunks keep theirs)."""
    return F.filter(F.split(F.lower(fold_marks(text) if fold else text), _SEPARATORS), lambda t: t != "")


@dataclass(frozen=True)
class Phrase:
    """Consecutive terms; the last may be a prefix."""

    terms: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Node:
    """``and``, ``or`` or ``not`` of two expressions."""

    kind: str
    left: Node | Phrase
    right: Node | Phrase


_LEXEMES = re.compile(r'\s*(?:(\()|(\))|"((?:[^"]|"")*)"(\*?)|([^\s()"]+))')


def parse_match(query: str) -> Node | Phrase:
    """Parse a match expression: NOT binds tighter than AND, that than OR; terms side by side are ANDed."""
    items = []
    at = 0
    while at < len(query.rstrip()):
        found = _LEXEMES.match(query, at)
        if not found or found.end() == at:
            raise ValueError(f"invalid match expression at {at}: {query}")
        at = found.end()
        opening, closing, quoted, star, bare = found.groups()
        if opening or closing:
            items.append(opening or closing)
        elif quoted is not None:
            items.append(_phrase(quoted.replace('""', '"'), star == "*"))
        elif bare in ("AND", "OR", "NOT"):
            items.append(bare)
        else:
            items.append(_phrase(bare.rstrip("*"), bare.endswith("*")))
    items = [x for x in items if x is not None]
    tree, rest = _or(items)
    if rest:
        raise ValueError(f"unexpected {rest[0]!r} in match expression: {query}")
    return tree


def _phrase(text: str, prefix: bool) -> Phrase | None:
    terms = tuple(t for t in re.split(r"[\W_]+", text.lower()) if t)
    return Phrase(terms, prefix) if terms else None


def _folded(phrase: Phrase, fold: bool) -> tuple[str, ...]:
    if not fold:
        return phrase.terms
    bare = str.maketrans(_MARKED, _BARE)
    return tuple("".join(c for c in t.translate(bare) if unicodedata.category(c) != "Mn") for t in phrase.terms)


def _or(items: list):
    left, items = _and(items)
    while items and items[0] == "OR":
        right, items = _and(items[1:])
        left = Node("or", left, right)
    return left, items


def _and(items: list):
    left, items = _not(items)
    while items and items[0] not in ("OR", ")"):
        right, items = _not(items[1:] if items[0] == "AND" else items)
        left = Node("and", left, right)
    return left, items


def _not(items: list):
    left, items = _atom(items)
    while items and items[0] == "NOT":
        right, items = _atom(items[1:])
        left = Node("not", left, right)
    return left, items


def _atom(items: list):
    if not items:
        raise ValueError("match expression ends early")
    if items[0] == "(":
        tree, items = _or(items[1:])
        if not items or items[0] != ")":
            raise ValueError("missing ) in match expression")
        return tree, items[1:]
    if isinstance(items[0], str):
        raise ValueError(f"unexpected {items[0]!r} in match expression")
    return items[0], items[1:]


def phrases(tree: Node | Phrase) -> list[Phrase]:
    """The phrases of an expression, each once, in order."""
    if isinstance(tree, Phrase):
        return [tree]
    return list(dict.fromkeys(phrases(tree.left) + phrases(tree.right)))


def occurrences(spaced_text: Column, phrase: Phrase, fold: bool = True) -> Column:
    """How often a phrase occurs in a text that ``spaced`` has written.

    Each token has blanks of its own, and of a hit only the first blank is
    consumed, so hits that overlap count and the time is linear in the text.
    """
    body = "  ".join(map(re.escape, _folded(phrase, fold)))
    return F.regexp_count(spaced_text, F.lit(f" (?={body}{'' if phrase.prefix else ' '})"))


def _holds(tree: Node | Phrase, counts: dict[Phrase, Column]) -> Column:
    if isinstance(tree, Phrase):
        return counts[tree] > 0
    left, right = _holds(tree.left, counts), _holds(tree.right, counts)
    return left & right if tree.kind == "and" else left | right if tree.kind == "or" else left & ~right


def clamp_limit(limit: int | None) -> int:
    """The limit, or the default outside 1..MAX_LIMIT."""
    return limit if limit is not None and 1 <= limit <= MAX_LIMIT else DEFAULT_LIMIT


def match(corpus: DataFrame, query: str, text_col: str = "text", fold: bool = True) -> DataFrame:
    """Rows whose text matches. Null texts aren't part of the corpus, empty ones are."""
    tree = parse_match(query)
    holds = let(spaced(F.col(text_col), fold), lambda t: _holds(tree, {p: occurrences(t, p, fold) for p in phrases(tree)}))
    return corpus.filter(F.col(text_col).isNotNull()).filter(holds)


def bm25(corpus: DataFrame, query: str, text_col: str = "text", fold: bool = True) -> DataFrame:
    """Matching rows with ``score``, higher being better; statistics are those of the whole corpus."""
    tree = parse_match(query)
    every = phrases(tree)
    names = [f"tf{i}" for i in range(len(every))]

    def counted(text: Column) -> Column:
        length = F.regexp_count(text, F.lit(" (?=[^ ])")).alias("dl")
        return F.struct(length, *[occurrences(text, p, fold).alias(n) for p, n in zip(every, names, strict=True)])

    # The counts come out of a generator, which filters and later columns can't reach through to count again.
    base = corpus.filter(F.col(text_col).isNotNull()).select("*", F.explode(F.array(let(spaced(F.col(text_col), fold), counted))).alias("__c"))
    stats = base.agg(
        F.count("*").alias("__n"), F.avg("__c.dl").alias("__avgdl"), *[F.sum((F.col(f"__c.{n}") > 0).cast("long")).alias(f"__df_{n}") for n in names]
    )
    scored = base.filter(_holds(tree, {p: F.col(f"__c.{n}") for p, n in zip(every, names, strict=True)})).join(F.broadcast(stats))
    score = F.lit(0.0)
    for n in names:
        df, tf = F.col(f"__df_{n}"), F.col(f"__c.{n}")
        idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("__n") - df + 0.5) / (df + 0.5)))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__c.dl") / F.col("__avgdl")))
    return scored.withColumn("score", score).select(*corpus.columns, "score")


def search(corpus: DataFrame, query: str, key: str, limit: int | None = None, where: Column | None = None, text_col: str = "text") -> DataFrame:
    """The best rows by score, then key; filters apply after the statistics."""
    found = bm25(corpus, query, text_col)
    return (found.filter(where) if where is not None else found).orderBy(F.desc("score"), key).limit(clamp_limit(limit))


def _entries(texts: Column, fold: bool) -> Column:
    """Array of (term, tf, positions) of an array of texts, each term once, in time n log n."""
    places = F.flatten(F.transform(texts, lambda t: F.transform(tokens(t, fold), lambda w, i: F.struct(w.alias("term"), i.alias("pos")))))

    def entries(ordered: Column) -> Column:
        # Where a run of equal terms begins.
        begins = F.filter(F.transform(ordered, lambda _, i: i), lambda i: (i == 0) | (F.get(ordered, i)["term"] != F.get(ordered, i - 1)["term"]))

        def entry(begins: Column, at: Column, j: Column) -> Column:
            tf = F.coalesce(F.get(begins, j + 1), F.size(ordered)) - at
            positions = F.transform(F.slice(ordered, at + 1, tf), lambda x: x["pos"])
            return F.struct(F.get(ordered, at)["term"].alias("term"), tf.cast("long").alias("tf"), positions.alias("positions"))

        return let(begins, lambda b: F.transform(b, lambda at, j: entry(b, at, j)))

    return let(F.sort_array(places), entries)


def postings(corpus: DataFrame, key: str, text_col: str = "text", fold: bool = True) -> DataFrame:
    """An inverted index: (key, term, tf, positions). Null texts have no entries.

    A text's entries are made where it lies and nothing is shuffled, unless rows
    share a key, which a look at the keys finds out: then texts meet by key first.
    """
    rows = corpus.filter(F.col(text_col).isNotNull())
    if corpus.groupBy(key).count().filter("count > 1").isEmpty():
        texts = rows.select(key, F.array(text_col).alias("__texts"))
    else:
        texts = rows.groupBy(key).agg(F.collect_list(text_col).alias("__texts"))
    return texts.select(key, F.inline(_entries(F.col("__texts"), fold)))


def update_postings(index: DataFrame, changed: DataFrame, removed: DataFrame, key: str, text_col: str = "text", fold: bool = True) -> DataFrame:
    """The index after rows were written (``changed``) and deleted (``removed``, keys).

    Entries of written and deleted keys go, then the written rows' new ones
    come; a text that became null thus leaves the index.
    """
    # Keys are hashed and texts stream past them: a sort would hold a task's texts in memory.
    gone = changed.select(key).unionByName(removed.select(key)).distinct().hint("shuffle_hash")
    return index.join(gone, key, "left_anti").select(*index.columns).unionByName(postings(changed, key, text_col, fold).select(*index.columns))


def match_postings(index: DataFrame, query: str, key: str) -> DataFrame:
    """Keys of the documents that match a phrase or conjunction of phrases, from the index alone.

    A phrase joins its terms' entries by key and keeps those with positions in
    a row, so only entries of the query's terms are read.
    """
    tree = parse_match(query)

    def found(node: Node | Phrase) -> DataFrame:
        if isinstance(node, Node):
            left, right = found(node.left), found(node.right)
            if node.kind == "or":
                return left.unionByName(right).distinct()
            return left.join(right, key, "left_semi" if node.kind == "and" else "left_anti")
        terms = _folded(node, True)
        out = None
        for at, term in enumerate(terms):
            last = node.prefix and at == len(terms) - 1
            entries = index.filter(F.col("term").startswith(term) if last else F.col("term") == term)
            places = entries.select(key, F.explode("positions").alias("__at")).select(key, (F.col("__at") - at).alias("__at"))
            out = places if out is None else out.join(places, [key, "__at"], "left_semi")
        return out.select(key).distinct()

    return found(tree)


def snippets(df: DataFrame, query: str, text_col: str = "text", start: str = "<mark>", end: str = "</mark>", gap: str = "...", size: int = SNIPPET_TOKENS) -> DataFrame:
    """The rows with ``snippet``: the window of ``size`` tokens with most distinct hits, marked."""
    wanted = [Phrase(_folded(p, True), p.prefix) for p in phrases(parse_match(query))]
    bare = str.maketrans(_MARKED, _BARE)

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
        low = [text[a:b].lower().translate(bare) for a, b in spans]
        hits: dict[int, int] = {}
        for p, phrase in enumerate(wanted):
            n = len(phrase.terms)
            for i in range(len(low) - n + 1):
                if all(low[i + k] == t for k, t in enumerate(phrase.terms[:-1])) and (low[i + n - 1].startswith(phrase.terms[-1]) if phrase.prefix else low[i + n - 1] == phrase.terms[-1]):
                    hits.update(dict.fromkeys(range(i, i + n), p))
        if not spans:
            return ""
        starts = sorted({max(0, min(i, len(spans) - size)) for i in hits} | {0})
        best = max(starts, key=lambda s: (len({p for i, p in hits.items() if s <= i < s + size}), -s))
        last = min(len(spans), best + size)
        out, at = [], spans[best][0] if best else 0
        for i in range(best, last):
            a, b = spans[i]
            out += [text[at:a], start + text[a:b] + end if i in hits else text[a:b]]
            at = b
        return ("" if best == 0 else gap) + "".join(out) + (text[at:] if last == len(spans) else gap)

    def marked(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    mark = F.pandas_udf(marked, T.StringType())
    return df.withColumn("snippet", mark(F.col(text_col)))


def file_results(found: DataFrame, path_col: str, language_col: str) -> DataFrame:
    """Found files as results: id ``file-path``, tags and score."""
    return found.select(
        F.concat(F.lit("file-"), F.col(path_col).cast("string")).alias("id"), F.col(path_col).alias("file_path"), F.array(F.lit("code"), F.col(language_col)).alias("tags"), "score"
    )


def escape_query(text: str) -> str:
    """The text with quotes doubled."""
    return text.replace('"', '""')


def as_phrase(text: str) -> str:
    """The text as one quoted phrase."""
    return f'"{escape_query(text)}"'
