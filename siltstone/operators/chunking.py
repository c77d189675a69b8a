"""Cutting of Markdown documents into chunks of about a target size."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

TARGET_TOKENS = 800
SCHEMA = "section int, chunk int, text string, start_line int, end_line int, is_large boolean, is_split boolean"

_HEADER = re.compile(r"##[ \t\n\f\r]+")
_SENTENCE = re.compile(r"[.!?]+[ \t\n\f\r]+")


@dataclass
class _Block:
    text: str
    first: int
    last: int


def _size(text: str) -> int:
    return len(text.encode()) // 4


def sections(lines: list[str]) -> list[tuple[int, list[str]]]:
    """Runs of lines that begin at a second-level header, with their first line number."""
    starts = [0] + [i for i, line in enumerate(lines) if i and _HEADER.match(line)]
    return [(a + 1, lines[a:b]) for a, b in zip(starts, [*starts[1:], len(lines)], strict=True)]


def paragraphs(lines: list[str], first: int) -> list[_Block]:
    """Blocks between blank lines; a fenced block is one, whatever it holds."""
    blocks: list[_Block] = []
    held: list[str] = []
    begin, fenced = first, False

    def close(last: int) -> None:
        text = "\n".join(held).strip()
        if text:
            blocks.append(_Block(text, begin, last))
        held.clear()

    for number, line in enumerate(lines, first):
        if line.startswith("```"):
            if fenced:
                held.append(line)
                close(number)
                begin = number + 1
            else:
                if held:
                    close(number - 1)
                held.append(line)
                begin = number
            fenced = not fenced
        elif fenced or line.strip():
            held.append(line)
        elif held:
            close(number - 1)
            begin = number + 1
    if held:
        close(first + len(lines) - 1)
    return blocks


def _packed(items: list, size_of, target: int) -> Iterator[list]:
    """Greedy runs of items whose sizes stay within the target."""
    run, total = [], 0
    for item in items:
        size = size_of(item)
        if total > 0 and total + size > target:
            yield run
            run, total = [], 0
        run.append(item)
        total += size
    if run:
        yield run


def chunk(text: str | None, target: int = TARGET_TOKENS, overlap: int = 0) -> list[tuple]:
    """Rows of SCHEMA for one document; ``overlap`` is accepted and has no effect.

    Small sections stay whole. Larger ones are packed from paragraphs, and
    paragraphs beyond the target from sentences, whose end marks are dropped.
    """
    if not text or not text.strip():
        return []
    out = []
    for number, (first, lines) in enumerate(sections(text.split("\n"))):
        whole = "\n".join(lines)
        if _size(whole) <= target:
            out.append((number, 0, whole.strip(), first, first + len(lines) - 1, False, False))
            continue
        index = 0
        waiting: list[_Block] = []

        def flush() -> None:
            nonlocal index
            if waiting:
                out.append((number, index, "\n\n".join(b.text for b in waiting), waiting[0].first, waiting[-1].last, False, False))
                index += 1
                waiting.clear()

        total = 0
        for block in paragraphs(lines, first):
            size = _size(block.text)
            if total > 0 and total + size > target:
                flush()
                total = 0
            if size > target:
                sentences = [s for s in (part.strip() for part in _SENTENCE.split(block.text)) if s]
                for run in _packed(sentences, _size, target):
                    out.append((number, index, " ".join(run), block.first, block.last, True, True))
                    index += 1
                continue
            waiting.append(block)
            total += size
        flush()
    return out


def chunk_documents(docs: DataFrame, key: str, text_col: str = "text", target: int = TARGET_TOKENS) -> DataFrame:
    """Rows (key, SCHEMA) of all documents, chunked in parallel where they lie."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, *[c.split()[0] for c in SCHEMA.split(", ")]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *row) for k, text in zip(frame[key], frame[text_col], strict=True) for row in chunk(text, target)]
            yield pd.DataFrame(rows, columns=names)

    return docs.select(key, text_col).mapInPandas(run, f"{key} {kind}, {SCHEMA}")


def paragraph_rows(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Rows (key, paragraph, text, start_line, end_line) of all documents."""
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, b.text, b.first, b.last) for k, text in zip(frame[key], frame[text_col], strict=True) for i, b in enumerate(paragraphs((text or "").split("\n"), 1))]
            yield pd.DataFrame(rows, columns=[key, "paragraph", "text", "start_line", "end_line"])

    return docs.select(key, text_col).mapInPandas(run, f"{key} {kind}, paragraph int, text string, start_line int, end_line int")
