"""Scalar expressions over paths, texts, identifiers and URLs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file extension.
LANGUAGES = {
    "go": "go", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "rs": "rust", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "php": "php", "rb": "ruby", "java": "java",
}
# How comment lines begin, by extension.
SLASH_COMMENTS = ("go", "js", "ts", "tsx", "jsx", "c", "cpp", "h", "java", "rs", "php")
HASH_COMMENTS = ("py", "rb", "sh")
# What marks a path as a test.
TEST_SUFFIXES = ("_test.go", ".test.ts", ".test.js", ".spec.ts", ".spec.js")
TEST_PARTS = ("/test/", "/tests/", "__tests__")
# White space that is trimmed from lines.
BLANKS = " \t\r\n\x0b\x0c\x85\xa0"
# What SQL's trim takes from both ends: characters of category Zs.
SPACES = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it.

    The optimizer copies an expression to every place that names its column,
    into lambda functions too, where it would run once for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rounded(value: Column, places: int) -> Column:
    """A double to so many places as SQL's ``round``: of value * 10^places halves go away from zero, and a zero keeps its sign.

    Spark's own ``round`` goes by the shortest decimal text and drops the sign of zero.
    """
    scale = F.lit(10.0**places)

    def near(pair: Column) -> Column:
        value, scaled = pair["v"], pair["s"]
        whole = F.rint(scaled)
        # Of two halves rint takes the even one.
        whole = F.when(F.abs(scaled) - F.abs(whole) == 0.5, whole + F.signum(scaled)).otherwise(whole)
        return F.when(F.abs(scaled) < float("inf"), whole / scale).otherwise(value)

    return let(F.struct(value.alias("v"), (value * scale).alias("s")), near)


def extension(path: Column) -> Column:
    """What follows the last dot of the last path component; empty without one."""
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def detect_language(path: Column) -> Column:
    """Language by extension, ``unknown`` for others."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(extension(path))), F.lit("unknown"))


def is_test_path(path: Column) -> Column:
    """Whether a path names a test file."""
    tests = [path.endswith(s) for s in TEST_SUFFIXES] + [path.contains(p) for p in TEST_PARTS]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def directory(path: Column) -> Column:
    """The path without its last component; empty at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/+[^/]*$", "")).otherwise(F.lit(""))


def package_dir(path: Column) -> Column:
    """The directory, ``main`` at the root."""
    return F.when(directory(path) == "", F.lit("main")).otherwise(directory(path))


def line_counts(text: Column, path: Column, blanks: str = BLANKS, empty: int = 0) -> Column:
    """Struct of total, blank, comment and code lines; a last line end ends no further line.

    ``blanks`` are trimmed from lines, and an empty text has ``empty`` (0 or 1) blank lines.
    """
    lines = F.split(text, "\n")
    ended = (F.element_at(lines, -1) == "") & (F.array_size(lines) > empty)
    lines = F.when(ended, F.slice(lines, F.lit(1), F.array_size(lines) - 1)).otherwise(lines)
    bare = F.transform(lines, lambda x: F.trim(x, F.lit(blanks)))
    slash, hashed = extension(path).isin(*SLASH_COMMENTS), extension(path).isin(*HASH_COMMENTS)
    total = F.array_size(lines)
    blank = F.array_size(F.filter(bare, lambda x: x == ""))
    comment = (
        F.when(slash, F.array_size(F.filter(bare, lambda x: x.startswith("//") | x.startswith("/*") | x.startswith("*"))))
        .when(hashed, F.array_size(F.filter(bare, lambda x: x.startswith("#"))))
        .otherwise(0)
    )
    return F.struct(total.alias("total"), blank.alias("blank"), comment.alias("comment"), (total - blank - comment).alias("code"))


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes."""
    return F.floor(F.octet_length(text) / 4).cast("int")


def file_hash(text: Column) -> Column:
    """SHA-256 in hex."""
    return F.sha2(text, 256)


def is_binary(content: Column) -> Column:
    """Whether a zero byte is among the first 512."""
    return F.position(F.lit(bytearray(1)), F.substring(content, 1, 512)) > 0


def normalize_url(url: Column) -> Column:
    """A git remote as host/path."""
    bare = F.trim(url, F.lit(BLANKS))
    for scheme in ("https://", "http://", "ssh://", "git://"):
        bare = F.regexp_replace(bare, f"^{scheme}", "")
    bare = F.regexp_replace(bare, r"\.git$", "")
    return F.when(bare.startswith("git@"), F.regexp_replace(F.regexp_replace(bare, "^git@", ""), "^([^:]*):", "$1/")).otherwise(bare)


def cache_key(remote: Column, root: Column) -> Column:
    """Eight hex digits of the remote's hash (zeros without one), a dash, eight of the root's."""
    url = normalize_url(remote)
    first = F.when(F.coalesce(url, F.lit("")) == "", F.lit("0" * 8)).otherwise(F.substring(F.sha2(url, 256), 1, 8))
    return F.concat(first, F.lit("-"), F.substring(F.sha2(root, 256), 1, 8))


def import_class(path: Column) -> Column:
    """Struct of is_standard_lib, is_relative and is_external."""
    standard = ~path.contains(".") & ~path.startswith("./")
    relative = path.startswith("./") | path.startswith("../")
    return F.struct(standard.alias("is_standard_lib"), relative.alias("is_relative"), (~standard & ~relative).alias("is_external"))


def name_parts(identifier: Column) -> Column:
    """Struct of name (after the last dot), receiver (before it, or null) and exported (capital first)."""
    tail = F.element_at(F.split(identifier, "::"), -1)
    name = F.substring_index(tail, ".", -1)
    receiver = F.when(tail.contains("."), F.regexp_replace(tail, r"\.[^.]*$", ""))
    return F.struct(name.alias("name"), receiver.alias("receiver"), name.rlike("^[A-Z]").alias("exported"))


def build_tags(language: Column, chunk_type: Column) -> Column:
    """[language, code or documentation, chunk_type], without empty ones."""
    content = F.when(chunk_type == "documentation", F.lit("documentation")).otherwise(F.lit("code"))
    return F.filter(F.array(language, content, chunk_type), lambda x: x.isNotNull() & (x != ""))


def derive_tags(chunk_type: Column, path: Column) -> Column:
    """[chunk_type, language, code], or markdown or text for documents."""
    language = detect_language(path)
    ext = extension(path)
    more = (
        F.when(language != "unknown", F.array(language, F.lit("code")))
        .when(ext == "md", F.array(F.lit("markdown")))
        .when(ext == "txt", F.array(F.lit("text")))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.concat(F.array(chunk_type), more)


def strip_modifiers(type_name: Column) -> Column:
    """A type without leading * and []; any map type is ``map``."""
    bare = F.regexp_replace(type_name, r"^(?:\*|\[\])+", "")
    return F.when(bare.startswith("map["), F.lit("map")).otherwise(bare)


def resolve_embedded(from_type: Column, field_type: Column, module_prefix: str) -> Column:
    """The id of an embedded type, seen from the type that embeds it."""
    bare = strip_modifiers(field_type)
    module = F.when(from_type.contains("::"), F.regexp_replace(from_type, "::[^:]*$", "")).otherwise(F.lit(""))
    package, name = F.regexp_replace(bare, r"\.[^.]*$", ""), F.substring_index(bare, ".", -1)
    return (
        F.when(field_type.contains("::"), field_type)
        .when(~bare.contains("."), F.when(module == "", bare).otherwise(F.concat(module, F.lit("::"), bare)))
        .when(package.startswith(module_prefix), F.concat(F.substring(package, len(module_prefix) + 1, 1 << 30), F.lit("::"), name))
        .when(~package.contains("/") & (module != ""), F.concat(module, F.lit("::"), package, F.lit("."), name))
        .otherwise(F.concat(package, F.lit("::"), name))
    )


def line_range(start: Column, end: Column) -> Column:
    """``(line n)`` or ``(lines a-b)``."""
    return F.when(start == end, F.concat(F.lit("(line "), start, F.lit(")"))).otherwise(F.concat(F.lit("(lines "), start, F.lit("-"), end, F.lit(")")))


def context_snippet(content: Column, start: Column, end: Column, context: int) -> Column:
    """The lines start..end with so many around them, under a line that names their range."""
    lines = F.split(content, "\n")
    first = F.greatest(F.lit(1), start - context)
    last = F.least(F.size(lines), end + context)
    body = F.array_join(F.slice(lines, first, F.greatest(F.lit(0), last - first + 1)), "\n")
    return F.concat(F.lit("// Lines "), first, F.lit("-"), last, F.lit("\n"), body)
