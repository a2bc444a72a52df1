"""Splitting oversized texts at natural boundaries (problem 7).

Content-defined chunking.  A rolling hash over the code points marks landmarks.
From the start of a piece the first landmark between the least and the greatest
size is taken and snapped to the nearest natural boundary (paragraph before line
before sentence before word); the next piece begins the overlap earlier, again at
a natural place.  As landmarks depend on the text around them only, an edit
alters the pieces near it and the cuts after it fall where they fell before.

Each text is cut by itself, so there is no shuffle.  The hash and the boundaries
of a text are found once for all configurations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASH_WINDOW = 48
#: Landmarks per span between the least and the greatest size, on average.
LANDMARKS = 6
#: A landmark looks for a boundary of the best class within this share of the greatest size.
SNAP = 0.1
#: More configurations than this are refused; they are parameters, not data.
MOST_CONFIGS = 1000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BATCH_CHARS = 4_000_000


@dataclass(frozen=True)
class Size:
    """config: its id; size: greatest length of a piece; overlap: characters repeated from the piece before."""

    config: int
    size: int
    overlap: int

    def __post_init__(self) -> None:
        if self.size < 1 or not 0 <= self.overlap < self.size:
            raise ValueError(f"configuration {self.config}: the size must be positive and greater than the overlap")

    @property
    def least(self) -> int:
        return min(self.size, max(self.size // 2, self.overlap + max(1, (self.size - self.overlap) // 2)))


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of the HASH_WINDOW code points before each position 0..n."""
    n = len(codes)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(n + 1, _BASE))
        back = np.cumprod(np.full(n + 1, np.uint64(pow(int(_BASE), -1, 1 << 64))))
        total = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:n])])
        ago = np.maximum(np.arange(n + 1) - HASH_WINDOW, 0)
        h = (total - total[ago]) * back
        h = (h ^ (h >> np.uint64(29))) * _MIX
        return h ^ (h >> np.uint64(32))


def _boundaries(codes: np.ndarray) -> list[np.ndarray]:
    """Places to cut at, best class first: before each lies a paragraph's, line's, sentence's or word's end."""
    space = np.isin(codes, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)) | (codes >= 0x2000) & (codes <= 0x200A)
    wide_stop = np.isin(codes, (0x3002, 0xFF01, 0xFF1F))
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1  # first character after white space
    # look at the run of white space before each place
    line = np.isin(codes, (10, 13, 0x85, 0x2028, 0x2029)) & ~((codes == 13) & np.append(codes[1:] == 10, False))
    lines = np.concatenate([[0], np.cumsum(line)])
    wordly = np.flatnonzero(~space)
    last = wordly[np.searchsorted(wordly, starts) - 1] if len(wordly) else starts
    last = np.where(last < starts, last, 0)
    breaks = lines[starts] - lines[last]
    stop = np.isin(codes, (33, 46, 63, 0x2026, 0x3002))
    close = np.isin(codes, (34, 39, 41, 93, 0x201D, 0x2019, 0xBB))
    ended = stop[last] | close[last] & stop[np.maximum(last - 1, 0)]
    sentence = np.union1d(starts[ended], np.flatnonzero(wide_stop) + 1)
    return [starts[breaks > 1], starts[breaks > 0], sentence[sentence < len(codes)], starts]


def _nearest(places: np.ndarray, to: int, low: int, high: int) -> int:
    """The place in [low, high] nearest to ``to`` (the earlier of two), or -1."""
    a, b = np.searchsorted(places, low), np.searchsorted(places, high, "right")
    if a == b:
        return -1
    k = min(max(int(np.searchsorted(places, to)), a), b - 1)
    if k > a and to - places[k - 1] <= abs(places[k] - to):
        k -= 1
    return int(places[k])


class _Cutter:
    def __init__(self, text: str) -> None:
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = len(self.codes)
        self.hashes = _hashes(self.codes)
        self.classes = _boundaries(self.codes)
        self.signs = np.flatnonzero(np.isin(self.codes, [ord(c) for c in "!,-./:;?_|"])) + 1

    def _whole(self, at: int, low: int) -> int:
        """A forced cut, moved back so that it doesn't part a letter from its marks or an emoji from its joiners."""
        c = self.codes
        while at > low and (0x300 <= c[at] < 0x370 or 0x200D in (c[at], c[at - 1]) or 0xFE00 <= c[at] < 0xFE10 or 0x1F3FB <= c[at] <= 0x1F3FF):
            at -= 1
        return at

    def spans(self, s: Size) -> Iterator[tuple[int, int]]:
        marks = np.flatnonzero(self.hashes % np.uint64(max(1, (s.size - s.least) // LANDMARKS)) == 0)
        start = last = 0
        while self.n - start > s.size:
            low, high = max(start + s.least, last + 1), start + s.size
            k = int(np.searchsorted(marks, low))
            mark = int(marks[k]) if k < len(marks) and marks[k] <= high else high
            reach = max(1, int(s.size * SNAP))
            end = -1
            for a, b in ((max(low, mark - reach), min(high, mark + reach)), (low, high), (max(start + 1 + s.overlap, last + 1), low)):
                for places in self.classes:
                    end = _nearest(places, mark, a, b)
                    if end > 0:
                        break
                if end > 0:
                    break
            if end < 0:  # no white space: after a mark or sign, else at the landmark
                end = _nearest(self.signs, mark, low, high)
                end = end if end > 0 else self._whole(mark, low)
            yield start, end
            start, last = self._again(start, end, s), end
        yield start, self.n

    def _again(self, start: int, end: int, s: Size) -> int:
        """Where the piece after the one that ends at ``end`` begins."""
        if not s.overlap:
            return end
        wish = end - s.overlap
        near = max(8, s.overlap // 4)
        least = max(start + 1, end + 2 - s.size)  # the next piece must be able to end later
        low, high = max(least, wish - near), min(end - 1, wish + near)
        for places in self.classes[2:]:
            if (at := _nearest(places, wish, low, high)) > 0:
                return at
        at = _nearest(self.signs, wish, low, high)
        return at if at > 0 else self._whole(max(least, wish), least)


def spans(text: str | None, size: Size) -> list[tuple[int, int]]:
    """(start, end) of each piece, end exclusive; one piece if the text fits, none for null and empty texts."""
    return list(_Cutter(text).spans(size)) if text else []


def configurations(configs: DataFrame, config_id: str = "config_id", size: str = "chunk_size", overlap: str = "chunk_overlap") -> list[Size]:
    """The configurations as parameters; rows with a null size are left out, a null overlap is 0."""
    rows = configs.where(F.col(size).isNotNull()).select(config_id, size, F.coalesce(F.col(overlap), F.lit(0))).limit(MOST_CONFIGS + 1).collect()
    if len(rows) > MOST_CONFIGS:
        raise ValueError(f"more than {MOST_CONFIGS} configurations")
    return [Size(*r) for r in rows]


def _cut(df: DataFrame, sizes: list[Size], id_col: str, text: str, with_text: bool) -> DataFrame:
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, config_id int, piece_no int, start_pos int, end_pos int" + ", text string" * with_text
    if not sizes:
        return df.sparkSession.createDataFrame([], schema)
    names = [id_col, "config_id", "piece_no", "start_pos", "end_pos", *["text"] * with_text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        weight = 0
        for b in batches:
            for key, t in zip(b.iloc[:, 0].tolist(), b.iloc[:, 1].tolist(), strict=True):
                cutter = _Cutter(t)
                for s in sizes:
                    if cutter.n <= s.size:
                        continue
                    for k, (start, end) in enumerate(cutter.spans(s)):
                        rows.append((key, s.config, k, start, end, *[t[start:end]] * with_text))
                        weight += 64 + (end - start) * with_text
                        if weight >= _BATCH_CHARS:
                            yield pd.DataFrame(rows, columns=names)
                            rows, weight = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    long = df.where(F.length(text) > min(s.size for s in sizes)).select(F.col(id_col).alias("_key"), F.col(text).alias("_text"))
    return long.mapInPandas(run, schema)


def piece_spans(df: DataFrame, sizes: list[Size], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, config_id, piece_no, start_pos, end_pos) of the pieces of every text that is longer than a configuration's size.

    Pieces are numbered from 0 in order and hold at most ``size`` code points.
    Texts that fit, null and empty ones have no rows.  Repeated rows are cut each
    by itself.
    """
    return _cut(df, sizes, id_col, text, with_text=False)


def pieces(df: DataFrame, sizes: list[Size], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``piece_spans`` with the piece's ``text``."""
    return _cut(df, sizes, id_col, text, with_text=True)
