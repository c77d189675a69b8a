"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.exact_dedup import exact_dedup
from siltstone.llm.langid import identify
from siltstone.llm.licenses import license_scan
from siltstone.llm.line_dedup import line_dedup
from siltstone.llm.mixing import mix
from siltstone.llm.ngram_join import near_groups
from siltstone.llm.packing import pack
from siltstone.llm.quality_classifier import classify
from siltstone.llm.quality_rules import quality_rules
from siltstone.llm.url_filters import host_of, path_of, url_filter


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a scorer trained on weak labels."""
    return classify(_documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, own and inherited.

    The table has no paths. A document lies in source/<thousand>/<hundred> of
    its id; every tenth is a file called LICENSE, of which every other lies in
    source/<thousand>.
    """
    is_file, above = F.col("doc_id") % 10 == 0, F.col("doc_id") % 20 == 0
    name = F.when(is_file, F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(F.concat(F.lit("file."), F.col("doc_id")))
    place = F.concat_ws("/", "source", F.expr("doc_id div 1000"), F.when(~above, F.expr("doc_id div 100")), name)
    files = _documents(spark, sf_dir).select("doc_id", place.alias("path"), "text")
    return license_scan(files, F.col("path").rlike("/LICENSE[^/]*$"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of all documents."""
    return exact_dedup(_documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeated three-line windows take from each document."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and the weak-supervision verdict for all documents."""
    found = quality_rules(_documents(spark, sf_dir), carry=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all documents."""
    return near_groups(_documents(spark, sf_dir)).drop("text_hash")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    import public_tokenizers

    pieces = pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents, learnt from three of four."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    found = identify(_documents(spark, sf_dir), fold != 2)
    return found.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from each document so that sources meet their targets."""
    mixed = mix(_documents(spark, sf_dir), carry=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries about the hosts of the pages, by a fixed rule.

    The tables hold no list. Every host whose name has a length divisible by
    three is listed as a domain on a day of 2024 set by that length; those of
    even length are allowed 60 days later and those divisible by five removed
    after 150. Every host under ``example.net`` is allowed as a host from July on.
    The last two labels of the hosts are listed as domains from March on where
    their length is even. Hosts with their first path segment are listed as
    prefixes from May on where the length leaves 1 when divided by three, and
    removed in September where it leaves 1 when divided by six.
    """
    hosts = pages.select(host_of(F.col("url")).alias("value")).filter("value != ''").distinct().withColumn("n", F.length("value"))
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(n * 7 % 200)")

    def entry(kind: str, action: str, when, after: int) -> DataFrame:
        return hosts.filter(when).select(
            F.lit(kind).alias("kind"), "value", F.lit(action).alias("action"), (start + F.expr(f"make_dt_interval({after})")).alias("listed_at")
        )

    n = F.col("n")
    dated = lambda kind, action, day: (F.lit(kind).alias("kind"), "value", F.lit(action).alias("action"), F.expr(f"timestamp_ntz'{day}'").alias("listed_at"))
    parents = hosts.select(F.regexp_extract("value", r"([^.]+\.[^.]+)$", 1).alias("value")).filter("value != ''").distinct()
    segment = F.get(F.filter(F.split(path_of(F.col("url")), "/"), lambda x: x != ""), F.lit(0))
    below = pages.select(host_of(F.col("url")).alias("host"), segment.alias("part")).filter("host != '' and part is not null").distinct()
    below = below.select(F.lower(F.concat("host", F.lit("/"), "part")).alias("value")).distinct().withColumn("n", F.length("value"))
    return (
        entry("domain", "block", n % 3 == 0, 0)
        .unionByName(parents.filter(F.length("value") % 2 == 0).select(*dated("domain", "block", "2024-03-01 06:00:00")))
        .unionByName(below.filter(n % 3 == 1).select(*dated("prefix", "block", "2024-05-01 00:00:00")))
        .unionByName(below.filter(n % 6 == 1).select(*dated("prefix", "remove", "2024-09-01 00:00:00")))
        .unionByName(entry("domain", "allow", (n % 3 == 0) & (n % 2 == 0), 60))
        .unionByName(entry("domain", "remove", (n % 3 == 0) & (n % 5 == 0), 150))
        .unionByName(
            hosts.filter(F.col("value").endswith(".example.net")).select(
                F.lit("host").alias("kind"), "value", F.lit("allow").alias("action"), F.expr("timestamp_ntz'2024-07-01 00:00:00'").alias("listed_at")
            )
        )
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged by the list entries active when they were fetched.

    Pages carry no fetch time; page n is fetched n * 37 % 365 days into 2024.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    at = F.expr("timestamp_ntz'2024-01-01 12:00:00' + make_dt_interval(cast(page_id * 37 % 365 as int))")
    return url_filter(pages.withColumn("fetched_at", at), list_entries(pages)).drop("url")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5_quality_rules that SQL can express: counts and base verdict of all documents."""
    return op5_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def packing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7_packing promises of all documents whatever the token ids.

    ``gapless``: the pieces follow each other from 0 to doc_tokens; ``fits``:
    every piece lies within 4096 places; ``empty``: the end token stands alone,
    as for texts of blanks.
    """
    pieces = op7_packing(spark, sf_dir).withColumn("stop", F.col("start") + F.col("length"))
    starts = F.array_sort(F.collect_list(F.struct("start", "stop")))
    per = pieces.groupBy("doc_id").agg(starts.alias("p"), F.max("doc_tokens").alias("n"), F.max(F.col("offset") + F.col("length")).alias("most"), F.min("length").alias("least"))
    first, last = F.get("p", F.lit(0))["start"], F.element_at("p", -1)["stop"]
    chained = F.forall(F.transform("p", lambda x, i: (i == 0) | (F.get(F.col("p"), i - 1)["stop"] == x["start"])), lambda x: x)
    return per.select(
        "doc_id", ((first == 0) & (last == F.col("n")) & chained).alias("gapless"), ((F.col("most") <= 4096) & (F.col("least") > 0)).alias("fits"), (F.col("n") == 1).alias("empty")
    )


def language_undecided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8_language_id that SQL can express: which documents have no language, and sane scores."""
    found = op8_language_id(spark, sf_dir)
    return found.select("doc_id", (F.col("lang_pred") == "und").alias("undecided"), F.col("score").between(0, 1).alias("in_range"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op9_mixing that SQL can express: sizes, targets, and that no document exceeds twice its size."""
    return op9_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target", (F.col("taken") <= 2 * F.col("size")).alias("within"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_license_scan": op2_license_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_mixing": op9_mixing,
    "op10_url_filter": op10_url_filter,
    "quality_counts": quality_counts,
    "packing_totals": packing_totals,
    "language_undecided": language_undecided,
    "mixing_targets": mixing_targets,
}

SQL = {
    "op3_exact_dedup": """
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS len,
                   sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS sha
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY sha ORDER BY len DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY sha) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY sha ORDER BY len DESC, doc_id) AS kept,
               sha AS text_sha256
        FROM d
    """,
    "op6_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams FROM w
        ), g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b USING (gram)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        ), comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id,
               coalesce(component_id, s.doc_id) = s.doc_id AS kept
        FROM s LEFT JOIN comp USING (doc_id)
    """,
    "op10_url_filter": r"""
        WITH p AS (
            SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
                   list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '')[1] AS part,
                   TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST(page_id * 37 % 365 AS INT)) AS fetched_at
            FROM pages
        ), h AS (
            SELECT DISTINCT host AS value, length(host) AS n,
                   TIMESTAMP '2024-01-01' + to_days(CAST(length(host) * 7 % 200 AS INT)) AS start
            FROM p WHERE host <> ''
        ), up AS (SELECT DISTINCT regexp_extract(value, '([^.]+\.[^.]+)$', 1) AS value FROM h
        ), below AS (SELECT DISTINCT lower(host || '/' || part) AS value, length(host || '/' || part) AS n FROM p WHERE host <> '' AND part IS NOT NULL
        ), e AS (
            SELECT 'domain' AS kind, value, 'block' AS action, start AS listed_at FROM h WHERE n % 3 = 0
            UNION ALL SELECT 'domain', value, 'allow', start + to_days(60) FROM h WHERE n % 3 = 0 AND n % 2 = 0
            UNION ALL SELECT 'domain', value, 'remove', start + to_days(150) FROM h WHERE n % 3 = 0 AND n % 5 = 0
            UNION ALL SELECT 'host', value, 'allow', TIMESTAMP '2024-07-01' FROM h WHERE value LIKE '%.example.net'
            UNION ALL SELECT 'domain', value, 'block', TIMESTAMP '2024-03-01 06:00:00' FROM up WHERE value <> '' AND length(value) % 2 = 0
            UNION ALL SELECT 'prefix', value, 'block', TIMESTAMP '2024-05-01' FROM below WHERE n % 3 = 1
            UNION ALL SELECT 'prefix', value, 'remove', TIMESTAMP '2024-09-01' FROM below WHERE n % 6 = 1
        ), listed AS (
            SELECT p.page_id, e.kind, e.value, arg_max(e.action, e.listed_at) AS action, max(e.listed_at) AS listed_at
            FROM p JOIN e ON e.listed_at <= p.fetched_at
             AND ((e.kind <> 'prefix' AND e.value = p.host) OR (e.kind = 'domain' AND suffix(p.host, '.' || e.value)) OR (e.kind = 'prefix' AND e.value = p.host || '/' || p.part))
            GROUP BY ALL
        ), best AS (
            SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY kind = 'prefix' DESC, kind = 'host' DESC, length(value) DESC) AS nth
            FROM listed WHERE action <> 'remove'
        )
        SELECT p.page_id, p.fetched_at, coalesce(b.action, 'pass') AS action,
               coalesce(b.kind || ':' || b.value, '') AS listed_as, b.listed_at, coalesce(b.action, 'pass') <> 'block' AS kept
        FROM p LEFT JOIN best b ON b.page_id = p.page_id AND b.nth = 1
    """,
    "op4_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, text, string_split(text, chr(10)) AS lines,
                   list_transform(string_split(text, chr(10)),
                       lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS bare
            FROM documents
        ), w AS (
            SELECT doc_id, i AS pos, bare[i] || chr(10) || bare[i + 1] || chr(10) || bare[i + 2] AS win
            FROM (SELECT doc_id, bare, unnest(range(1, len(bare) - 1)) AS i FROM l WHERE len(bare) >= 3)
        ), ranked AS (
            SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM w WHERE length(win) > 2
        ), gone AS (
            SELECT doc_id, list(DISTINCT line) AS gone
            FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS line FROM ranked WHERE nth > 1) GROUP BY doc_id
        )
        SELECT l.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(
                   list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(gone, i)), lambda i: lines[i]), chr(10)), '') END) AS text_sha256
        FROM l LEFT JOIN gone USING (doc_id)
    """,
    "quality_counts": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), windows AS (
            SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d)
        ), again AS (
            SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
        ), covered AS (
            SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest(range(5)) AS k) GROUP BY doc_id
        ), lines AS (
            SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
            FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
               CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
               CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
               len(words) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(words) AS base_failed
        FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
    """,
    "packing_totals": r"SELECT doc_id, true AS gapless, true AS fits, NOT regexp_matches(coalesce(text, ''), '[^\x20\x09-\x0D]') AS empty FROM documents",
    "language_undecided": r"SELECT doc_id, NOT regexp_matches(coalesce(text, ''), '\p{L}') AS undecided, true AS in_range FROM documents",
    "mixing_targets": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS s, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w FROM d GROUP BY source
        ), filled AS (
            -- Sources reach their stop in the order of size by weight; before each, rest is what the earlier ones leave.
            SELECT *, 1.5::DOUBLE * sum(s) OVER () - coalesce(sum(2 * s) OVER (ORDER BY s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                   sum(w) OVER (ORDER BY s / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight
            FROM s
        ), free AS (
            SELECT rest, weight, row_number() OVER (ORDER BY s / w, source) AS nth FROM filled WHERE 2 * s * weight > rest * w
        ), t AS (
            SELECT filled.source, s, CASE WHEN f.rest IS NULL OR 2 * s * f.weight <= f.rest * w THEN 2.0::DOUBLE * s ELSE f.rest * w / f.weight END AS target
            FROM filled LEFT JOIN (SELECT * FROM free WHERE nth = 1) f ON true
        )
        SELECT doc_id, size, s AS source_size, CAST(target AS DOUBLE) AS target, true AS within FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    """,
}
