"""Texts of a file's structure: symbols, definitions and data, as chunks hold them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.scalars import line_range

# Words before a constant and a variable, by language; others have none.
CONSTANT_WORDS = {"go": "const ", "typescript": "const ", "javascript": "const "}
VARIABLE_WORDS = {"go": "var ", "typescript": "let ", "javascript": "let "}


def _by_language(language: Column, words: dict[str, str]) -> Column:
    out = F.lit("")
    for name, word in words.items():
        out = F.when(language == name, F.lit(word)).otherwise(out)
    return out


def _lines(entry: Column) -> Column:
    return line_range(entry["start_line"], entry["end_line"])


def symbols_text(package: Column, imports: Column, types: Column, functions: Column) -> Column:
    """Package, number of imports, types (name, kind, lines) and functions (signature, name, lines); parts that are empty are left out."""
    kinds = F.transform(types, lambda t: F.concat(F.lit("  - "), t["name"], F.lit(" ("), t["kind"], F.lit(") "), _lines(t)))
    calls = F.transform(functions, lambda f: F.concat(F.lit("  - "), F.coalesce(F.nullif(f["signature"], F.lit("")), F.concat(f["name"], F.lit("()"))), F.lit(" "), _lines(f)))
    return F.concat_ws(
        "\n\n",
        F.when(package != "", F.concat(F.lit("Package: "), package)),
        F.when(imports > 0, F.concat(F.lit("Imports: "), imports.cast("string"), F.lit(" packages"))),
        F.when(F.size(types) > 0, F.concat(F.lit("Types:\n"), F.array_join(kinds, "\n"))),
        F.when(F.size(functions) > 0, F.concat(F.lit("Functions:\n"), F.array_join(calls, "\n"))),
    )


def definitions_text(definitions: Column) -> Column:
    """Code of definitions (code, lines), each under a comment with its lines."""
    return F.array_join(F.transform(definitions, lambda d: F.concat(F.lit("// "), _lines(d), F.lit("\n"), d["code"])), "\n\n")


def data_text(constants: Column, variables: Column, language: Column) -> Column:
    """Constants, then variables (name, type, value, lines), written as the language does; Go shows types."""

    def written(entries: Column, words: dict[str, str]) -> Column:
        word = _by_language(language, words)
        kind = lambda e: F.when((language == "go") & (e["type"] != ""), F.concat(F.lit(" "), e["type"])).otherwise(F.lit(""))
        return F.transform(entries, lambda e: F.concat(F.lit("// "), _lines(e), F.lit("\n"), word, e["name"], kind(e), F.lit(" = "), e["value"]))

    return F.array_join(F.concat(written(constants, CONSTANT_WORDS), written(variables, VARIABLE_WORDS)), "\n\n")
