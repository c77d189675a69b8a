"""Quality rules by weak supervision, in DataFrame operations only.

Each rule looks at counts of one text and votes good, bad or abstains. Rules
overlap: each kind of junk is seen by several of them (noise of symbols also
spoils plain words and function words), so that one rule that misfires is
outvoted. Their accuracies and the share of good documents come from
expectation-maximisation over the vote patterns of all documents that pass the
base, and a document stays when its posterior probability of being good reaches
a half. Two base rules reject beforehand: too few words, or too many words in
repeated five-word windows.

Cases: null and empty texts have no words and fail the base. Counts of a text
take time n log n in its length. Repeated rows get equal verdicts. An empty
table gives an empty result. Columns of the input that bear the name of a
count are replaced. Texts in languages whose function words aren't listed get
a vote for bad from that rule alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._work import SPACES, stored, words
from siltstone.llm.weak import VoteModel, fit_votes, pattern

# Fixed value of the contract: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_stops", "n_common", "n_plain"]
# Frequent function words of English, German, French and Spanish.
COMMON = (
    "a an and are as at be by for from has he in is it not of on or that the this to was were which with "
    "auf das dem den der des die ein eine er für im ist mit nicht sich sie sind und von war zu "
    "au aux ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "como con del el es las lo los más no o para pero por se su sus una y"
).split()
# A word of letters, small but perhaps for the first, with one mark behind it at most.
PLAIN = "(?<!\\S)\\p{L}[\\p{Ll}'’-]*[.,;:?!]?(?!\\S)"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SPAN = 5


def _count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measured(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """The carried columns and COUNTS (long) of each text."""
    carried = [c for c in carry if c not in COUNTS]
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(*carried, text.alias("__t"), words(F.col(text_col)).alias("__w"), F.split(text, "\n").alias("__l"))
    hashes = F.transform(F.col("__w"), lambda w: F.xxhash64(w))
    full = F.filter(F.col("__l"), lambda line: F.length(F.trim(line, F.lit(SPACES))) > 0)
    step = base.select(*carried, "__t", "__w", hashes.alias("__h"), full.alias("__l"))
    h = F.col("__h")
    windows = F.when(
        F.size(h) > SPAN, F.transform(F.sequence(F.lit(0), F.size(h) - SPAN), lambda i: F.xxhash64(*[h[i + k] for k in range(SPAN)]))
    ).otherwise(F.array().cast("array<bigint>"))
    step = step.withColumn("__g", windows)
    g = F.col("__g")
    repeats = F.size(F.array_distinct(g)) < F.size(g)
    # Windows sorted by hash stand beside their equals; the positions of such
    # windows, sorted again, cover min(SPAN, gap to the next) words each.
    sorted_windows = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    step = step.withColumn("__s", F.when(repeats, sorted_windows))
    s = F.col("__s")
    found = F.sort_array(
        F.transform(
            F.filter(s, lambda x, i: (F.get(s, i - 1)["x"].eqNullSafe(x["x"])) | (F.get(s, i + 1)["x"].eqNullSafe(x["x"]))), lambda x: x["i"]
        )
    )
    step = step.withColumn("__f", found)
    f = F.col("__f")
    gaps = F.transform(f, lambda at, i: F.least(F.lit(SPAN), F.coalesce(F.get(f, i + 1) - at, F.lit(SPAN))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, b: a + b), F.lit(0))
    t = F.col("__t")
    known = sorted({form for word in COMMON for form in (word, word.capitalize())})
    values = {
        "n_words": F.size("__w"),
        "word_chars": F.length(F.array_join("__w", "")),
        "n_symbols": _count_chars(t, SYMBOLS),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": covered,
        "n_lines": F.size("__l"),
        "n_upper": _count_chars(t, UPPER),
        "n_shouts": F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))),
        "n_stops": F.length(t) - F.length(F.replace(t, F.lit("."), F.lit(""))),
        "n_common": F.size(F.filter("__w", lambda w: w.isin(known))),
        "n_plain": F.regexp_count(t, F.lit(PLAIN)),
    }
    return step.select(*carried, *[values[c].cast("long").alias(c) for c in COUNTS])


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes() -> list[Column]:
    """One vote for each rule, on the columns COUNTS."""
    n, c = F.col("n_words"), F.col
    return [
        _vote(n >= 50, n < 20),
        _vote(c("word_chars").between(3 * n, 12 * n), (c("word_chars") < 2 * n) | (c("word_chars") > 20 * n)),
        _vote(c("n_symbols") * 50 <= n, c("n_symbols") * 10 > n),
        _vote(c("n_dup_lines") == 0, c("n_dup_lines") * 3 > c("n_lines")),
        _vote(c("n_repeat_words") == 0, c("n_repeat_words") * 10 > n),
        _vote(
            (c("n_upper") * 10 <= c("word_chars")) & (c("n_shouts") * 20 <= n), (c("n_upper") * 3 > c("word_chars")) | (c("n_shouts") * 10 > n)
        ),
        _vote(c("n_stops") * 60 >= n, (c("n_stops") == 0) & (n >= 60)),
        _vote(c("n_common") * 10 >= n, (c("n_common") * 25 < n) & (n >= 20)),
        _vote(c("n_plain") * 10 >= 9 * n, c("n_plain") * 10 < 7 * n),
    ]


def base_failed() -> Column:
    """Whether the base rules reject a document, on the columns COUNTS."""
    n = F.col("n_words")
    return (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > MAX_REPEAT_PERCENT * n)


def fit_rules(measures: DataFrame) -> VoteModel:
    """Accuracies of the rules from the vote patterns of all rows that pass the base."""
    rules = votes()
    passed = measures.filter(~base_failed())
    return fit_votes(passed.groupBy(pattern(rules).alias("code")).agg(F.count("*").alias("n")), len(rules))


def quality_rules(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """The carried columns (default: all), COUNTS, base_failed, quality (double) and kept."""
    measures = stored(measured(docs, text_col, carry if carry is not None else docs.columns), "measures")
    model = fit_rules(measures)
    return (
        measures.withColumn("base_failed", base_failed())
        .withColumn("quality", model.posterior(votes()))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
    )
