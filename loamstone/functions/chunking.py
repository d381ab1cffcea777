"""Cutting documents into chunks: markdown sections under a token budget, and dialogue turns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADER = re.compile(r"^(#{1,6})\s+(.*)$")
#: a speaker is up to 30 letters, digits, blanks and a few signs
_SPEAKER = re.compile(r"^([A-Za-z0-9 _?+.'\-]{1,30}):\s*(.*)$")
MOST, LEAST = 512, 64


def _tokens(text: str) -> int:
    return -(-len(text) // 4)


def sections(text: str, level: int = 2) -> list[tuple[str, str]]:
    """(title, body): a header of at most ``level`` starts a section; text before the first is an untitled one; sections without a body are left out."""
    out, title, body = [], "", []
    for line in text.split("\n"):
        found = _HEADER.match(line)
        if found and len(found[1]) <= level:
            out.append((title, "\n".join(body).strip()))
            title, body = found[2].strip(), []
        else:
            body.append(line)
    out.append((title, "\n".join(body).strip()))
    return [(t, b) for t, b in out if b]


def _words_packed(head: str, paragraph: str, most: int) -> Iterator[str]:
    now = ""
    for word in paragraph.split():
        longer = f"{now} {word}".strip()
        if now and _tokens(head + longer) > most:
            yield head + now
            longer = word
        now = longer
    if now:
        yield head + now


def packed(title: str, body: str, most: int = MOST) -> list[str]:
    """A section as chunks: whole if it fits, else paragraphs packed in order under the title; a paragraph too large is packed by words."""
    head = f"# {title}\n\n" if title else ""
    if _tokens(head + body) <= most:
        return [head + body]
    out, now = [], ""
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n", body))):
        longer = f"{now}\n\n{paragraph}".strip()
        if _tokens(head + longer) <= most:
            now = longer
            continue
        if now:
            out.append(head + now)
        now = paragraph
        if _tokens(head + paragraph) > most:
            out += _words_packed(head, paragraph, most)
            now = ""
    return [*out, head + now] if now else out


def merged(chunks: list[str], least: int = LEAST) -> list[str]:
    """Tiny chunks of one section join the one before; a leading tiny one joins the next."""
    out: list[str] = []
    for text in chunks:
        if out and _tokens(text) < least:
            out[-1] = f"{out[-1]}\n\n{text}"
        else:
            out.append(text)
    return [f"{out[0]}\n\n{out[1]}", *out[2:]] if len(out) > 1 and _tokens(out[0]) < least else out


def markdown(text: str, level: int = 2, most: int = MOST, least: int = LEAST) -> list[tuple[str, str]]:
    return [(t, c) for t, b in sections(text, level) for c in merged(packed(t, b, most), least)]


def turns(text: str) -> list[tuple[str, str]]:
    """(speaker, text): blocks between blank lines whose first line is ``Speaker: ...``; other blocks belong to the turn before."""
    out: list[tuple[str, str]] = []
    for block in re.split(r"\n\s*\n", text):
        lines = [line for line in block.split("\n") if line.strip()]
        found = _SPEAKER.match(lines[0].strip()) if lines else None
        if found:
            out.append((found[1].strip(), "\n".join([found[2].strip(), *lines[1:]]).strip()))
        elif lines and out:
            out[-1] = (out[-1][0], "\n".join([out[-1][1], *lines]))
    return out


CHUNKERS: dict[str, Callable[[str], list[tuple[str, str]]]] = {"markdown": markdown, "turns": turns}


def register_chunker(name: str, chunker: Callable[[str], list[tuple[str, str]]]) -> None:
    CHUNKERS[name] = chunker


def chunked(docs: DataFrame, chunker: str = "markdown", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk from 0, title, text); a null text has no chunks."""
    cut = CHUNKERS[chunker]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, title, text) for i, whole in zip(batch["id"], batch["text"], strict=True) for k, (title, text) in enumerate(cut(whole))]
            yield pd.DataFrame(rows, columns=["id", "chunk", "title", "text"])

    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInPandas(run, "id long, chunk int, title string, text string")
