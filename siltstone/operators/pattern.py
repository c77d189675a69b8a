"""Structural pattern search: a token-level subset.

A pattern is code with metavariables: ``$NAME`` stands for one node, which here
is a run of tokens balanced in brackets without a comma or semicolon at its top
level nor a line end there, and ``$$$NAME`` for any balanced run. Repeats of a name must be equal.
"""

from __future__ import annotations

import posixpath
import re
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from siltstone.work import dealt

# Fixed values of requests.
LANGUAGES = ("go", "typescript", "javascript", "tsx", "jsx", "python", "rust", "c", "cpp", "java", "php", "ruby")
STRICTNESS = ("cst", "smart", "ast", "relaxed", "signature")
MAX_CONTEXT, DEFAULT_CONTEXT = 10, 3
MAX_LIMIT, DEFAULT_LIMIT = 100, 50

SCHEMA = "line int, end_line int, match_text string, metavars map<string,string>"
_TOKEN = re.compile(r"\$\$\$\w*|\$\w+|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\w+|[^\w\s]")
_OPEN, _CLOSE = "([{", ")]}"


class PatternError(ValueError):
    """A request that the user can mend."""


class PatternSystemError(RuntimeError):
    """A failure that isn't the user's."""


# What marks a message as the user's to mend; seconds that the search of one text may take.
USER_MARKS = ("invalid", "unsupported", "outside project root", "timed out")
TIMEOUT = 30.0


def as_pattern_error(error: Exception) -> Exception:
    """A failure of a search as the user's or the system's, by its message."""
    if isinstance(error, (PatternError, PatternSystemError)):
        return error
    message = str(error)
    return PatternError(message) if any(mark in message for mark in USER_MARKS) else PatternSystemError(message)


class _Clock:
    """Raises PatternError when a search takes too long; looks at the time every 1024 steps."""

    def __init__(self, seconds: float):
        self.steps, self.until = 0, time.monotonic() + seconds

    def tick(self) -> None:
        self.steps += 1
        if not self.steps & 1023 and time.monotonic() > self.until:
            raise PatternError("pattern search timed out")


def check_request(request: dict) -> dict:
    """The request with defaults; raises PatternError on invalid values."""
    out = {"strictness": "smart", "context_lines": DEFAULT_CONTEXT, "limit": DEFAULT_LIMIT} | {k: v for k, v in request.items() if v is not None}
    if not str(out.get("pattern", "")).strip():
        raise PatternError("pattern is required")
    if out.get("language") not in LANGUAGES:
        raise PatternError(f"unsupported language: {out.get('language')}")
    if out["strictness"] not in STRICTNESS:
        raise PatternError(f"invalid strictness: {out['strictness']}")
    if not 0 <= out["context_lines"] <= MAX_CONTEXT:
        raise PatternError(f"context_lines must be between 0 and {MAX_CONTEXT}")
    if not 1 <= out["limit"] <= MAX_LIMIT:
        raise PatternError(f"limit must be between 1 and {MAX_LIMIT}")
    out["file_paths"] = [safe_path(p) for p in out.get("file_paths") or []]
    return out


def safe_path(path: str) -> str:
    """The normal form of a path within the project; others are errors."""
    normal = posixpath.normpath(path.replace("\\", "/"))
    if posixpath.isabs(normal) or normal == ".." or normal.startswith("../") or re.match(r"[A-Za-z]:", normal):
        raise PatternError(f"path leaves the project: {path}")
    return normal


def _runs(tokens: list[str], at: int, single: bool, breaks: set[int]) -> Iterator[int]:
    """Ends of balanced runs that begin at a position, the shortest first."""
    if not single:
        yield at
    depth = 0
    for i in range(at, len(tokens)):
        token = tokens[i]
        if token in _CLOSE:
            depth -= 1
            if depth < 0:
                return
        if single and depth == 0 and (token in ",;" or (i > at and i in breaks)):
            return
        if token in _OPEN:
            depth += 1
        if depth == 0:
            yield i + 1


def _match(pattern: list[str], p: int, tokens: list[str], at: int, bound: dict[str, tuple[int, int]], breaks: set[int], clock: _Clock) -> Iterator[tuple[int, dict]]:
    clock.tick()
    if p == len(pattern):
        yield at, bound
        return
    item = pattern[p]
    if item.startswith("$"):
        name = item.lstrip("$")
        for end in _runs(tokens, at, not item.startswith("$$$"), breaks):
            known = bound.get(name)
            if known is not None and name != "_" and tokens[known[0] : known[1]] != tokens[at:end]:
                continue
            yield from _match(pattern, p + 1, tokens, end, bound | {name: (at, end)} if name else bound, breaks, clock)
    elif at < len(tokens) and tokens[at] == item:
        yield from _match(pattern, p + 1, tokens, at + 1, bound, breaks, clock)


def find(pattern: str, text: str | None, timeout: float = TIMEOUT) -> list[tuple]:
    """Rows of SCHEMA: the matches in a text, from left to right, not overlapping; PatternError beyond the time limit."""
    clock = _Clock(timeout)
    wanted = _TOKEN.findall(pattern)
    found = list(_TOKEN.finditer(text or ""))
    tokens = [m[0] for m in found]
    # Positions of tokens that begin a line.
    breaks = {i for i in range(1, len(found)) if "\n" in text[found[i - 1].end() : found[i].start()]}
    out, at = [], 0
    while at < len(tokens):
        clock.tick()
        hit = next(_match(wanted, 0, tokens, at, {}, breaks, clock), None)
        if hit is None or hit[0] == at:
            at += 1
            continue
        end, bound = hit
        begin, stop = found[at].start(), found[end - 1].end()
        line = text.count("\n", 0, begin) + 1
        texts = {n: text[found[a].start() : found[b - 1].end()] if b > a else "" for n, (a, b) in bound.items()}
        out.append((line, line + text.count("\n", begin, stop), text[begin:stop], texts))
        at = end
    return out


def pattern_match(files: DataFrame, pattern: str, key: str = "file_path", text_col: str = "content") -> DataFrame:
    """Rows (key, SCHEMA) of all matches in all files."""
    kind = files.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *row) for k, text in zip(frame[key], frame[text_col], strict=True) for row in find(pattern, text)]
            yield pd.DataFrame(rows, columns=[key, "line", "end_line", "match_text", "metavars"])

    return dealt(files.select(key, text_col), key).mapInPandas(run, f"{key} {kind}, {SCHEMA}")
