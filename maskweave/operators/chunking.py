"""Splitting texts into chunks for a detector."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators, the strongest first; "" cuts anywhere.
SEPARATORS = ("\n\n", "\n", " ", "")
MARKDOWN = (r"\n#{1,6} ", "```\n", r"\n\*\*\*+\n", r"\n---+\n", r"\n___+\n", "\n\n", "\n", " ", "")


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the strongest separator that a text holds.

    Pieces are packed as long as they fit; a chunk begins with as many of the
    last pieces of the one before as fit into ``overlap``.  White space at the
    ends of chunks is left out.
    """
    if size < 1 or overlap < 0 or overlap > size:
        raise ValueError("the size must be positive and the overlap at most the size")
    at = next((i for i, s in enumerate(separators) if s == "" or re.search(s, text)), len(separators) - 1)
    here, weaker = separators[at], separators[at + 1 :]
    # a separator stays at the beginning of the piece after it
    starts = [0, *[m.start() for m in re.finditer(here, text) if m.start()], len(text)] if here else list(range(len(text) + 1))
    pieces = [text[a:b] for a, b in zip(starts, starts[1:], strict=False) if b > a]
    out: list[str] = []
    window: list[str] = []
    held = 0

    def close() -> None:
        if chunk := "".join(window).strip():
            out.append(chunk)

    for piece in pieces:
        if len(piece) > size:
            close()
            window, held = [], 0
            if weaker:
                out += split_text(piece, size, overlap, weaker)
            else:
                out.append(piece)
            continue
        if held + len(piece) > size:
            close()
            while window and (held > overlap or held + len(piece) > size):
                held -= len(window.pop(0))
        window.append(piece)
        held += len(piece)
    close()
    return out


def chunks(docs: DataFrame, size: int, overlap: int = 0, doc: str = "doc_id", text: str = "text", markdown: bool = False) -> DataFrame:
    """(doc, chunk_idx, text): the chunks of every text; null and blank texts have none."""
    separators = MARKDOWN if markdown else tuple(re.escape(s) for s in SEPARATORS)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap, separators))

    short = F.length(text) <= size
    trimmed = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    whole = docs.where(short & (trimmed != "")).select(doc, F.lit(0).alias("chunk_idx"), trimmed.alias("text"))
    cut = docs.where(~short).select(doc, F.posexplode(run(F.col(text))).alias("chunk_idx", "text"))
    return whole.unionByName(cut)


def fixed(text: Column, size: int, stride: int) -> Column:
    """Chunks of ``size`` characters every ``stride`` characters; none for an empty text."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(stride)), lambda i: F.substr(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def packed(units: list[str], head: str, size: int) -> Iterator[str]:
    """Units packed under a heading into batches of at most ``size`` characters; a longer unit stands alone."""
    batch, held = [head], len(head)
    for unit in units:
        if len(batch) > 1 and held + 1 + len(unit) > size:
            yield "\n".join(batch)
            batch, held = [head], len(head)
        batch.append(unit)
        held += 1 + len(unit)
    if len(batch) > 1:
        yield "\n".join(batch)
