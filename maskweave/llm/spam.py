"""Keyword-stuffed and link-list pages (problem 10).

A text is read as tokens: links (bare, Markdown or HTML with their caption),
hashtags, numbers, function words and other words.  Two signals are taken from
the positions of the tokens:

* recurrence gaps: whether a word returns within ``GAP`` (``SHORT_GAP``,
  ``LIST_GAP``) tokens;
* positional autocorrelation: the share of positions in a window at which the
  same word stands ``lag`` tokens before, for each lag beyond ``SHORT_GAP`` (up
  to it every return is a short gap already) up to ``LAGS``.  Runs of more than
  ``PHRASE`` tokens that return whole are repeated sentences, as in notices and
  records, and don't count.

Every token then looks at the ``WINDOW`` tokens around it.  The place is unnatural
if recurring words, links and hashtags are dense there and function words are
missing (lists that draw on the same terms), if it is filled with words that are all
different, without function words, numbers or the marks of sentences, records and
tables (lists of distinct nouns, whether or not any returns), or if words recur at such short or regular
distances that function words change nothing (stuffed sentences; a notice that
repeats its sentences recurs at longer ones).  Records (logs, tables, contact
lists) are told apart by their numbers, prose and glossaries by their function
words.  A page is spam if most of its text is unnatural.

Everything is a function of one text, so there is no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = 24
#: Gap within which keywords return in stuffed sentences; a repeated sentence takes longer to return.
SHORT_GAP = 8
#: Gap within which a list without any function words draws on the same few terms.
LIST_GAP = 48
WINDOW = 24
#: Largest lag at which words return regularly, and the longest run of tokens that is a keyword then.
LAGS, PHRASE = GAP, 4
#: Shares within a window.
LIST_DENSE, LIST_FUNCTION_WORDS, BARE_FUNCTION_WORDS = 0.34, 0.17, 0.12
STUFFED_DENSE, STUFFED_FUNCTION_WORDS = 0.32, 0.4
MOST_NUMBERS = 0.3
#: Shares within a window of a list of distinct words: words that it holds once, function words, numbers and marks.
UNIQUE_WORDS, UNIQUE_FUNCTION_WORDS, UNIQUE_NUMBERS, UNIQUE_MARKS = 0.75, 0.05, 0.1, 0.1
#: Share of a text (links weigh as LINK_WEIGHT words, hashtags as TAG_WEIGHT) that is unnatural in spam.
SPAM_SHARE = 0.57
#: A text of at least this share is read again without its repeated sentences.
DOUBTFUL_SHARE = 0.25
LINK_WEIGHT, TAG_WEIGHT = 2, 2
LEAST_TOKENS = 6

#: Frequent function words of the corpus's languages (en, de, es, fr).
FUNCTION_WORDS = frozenset(
    """
    a about an and are as at be been but by can could did do for from had has have he her his i if in into is it its my
    no nobody not of on or our please she since so that the their then there they this to until was we were what when
    which who will with would you your
    als am an auf aus bei das dem den der des die ein eine einem einen einer er es für hat haben ich im in ist mit nach
    nicht noch oder sich sie und unter von werden wir wurde zu zum zur
    al antes con de del el en es fue ha han la las le les lo los no para por que se si su un una y
    au aux ce cette d dans depuis des du elle est et il l le les n ne on par pas pour qu que qui reste sur une à été
    """.split()
)

_TOKEN = r"\[[^\]\n]{0,80}\]\([^)\s]{3,300}\)|<a\s[^>]{0,300}>[^<]{0,100}</a>|(?:https?://|www\.)\S+|#\w[\w-]*|\w+"
#: Between two tokens: the end of a sentence, a field's name, code.
_MARK = re.compile(r"[.!?…](?=\s|[\"'»”)]|$)|[:=(){}\\]|[。！？：]")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]+")


def _windows(n: int, width: int) -> np.ndarray:
    """First position of the window of ``width`` positions around each of n; windows at the ends are shifted inwards."""
    return np.minimum(np.maximum(np.arange(n) - width // 2, 0), n - width)


def _around(x: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """Mean of x over the window of ``width`` positions that begins at ``low``, for each position."""
    total = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=total[1:])
    return ((total[width:] - total[:-width]) / width)[low]


def _without_repeats(text: str) -> str:
    """The text without second copies (but for numbers) of sentences that have function words."""
    kept, seen = [], set()
    for s in re.split(r"(?<=[.!?])\s+|(?<=,)\s+(?=[A-ZÀ-Þ])|\n+|<\|\w+\|>", text):
        words = re.findall(r"[^\W\d_]+", re.sub(r"\S*(?:://|www\.)\S*", " ", s.lower()))
        if len(words) > 3 and any(w in FUNCTION_WORDS for w in words):
            if tuple(words) in seen:
                continue
            seen.add(tuple(words))
        kept.append(s)
    return "\n".join(kept)


def unnatural_share(text: str | None, find) -> float:
    """Share of a text that is unnatural; 0 for null, empty and very short texts.

    Repetition of whole sentences is a notice's way, not a keyword list's, so a
    doubtful text is read again with each sentence once.
    """
    if not text:
        return 0.0
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    share = _share(text, find)
    return _share(_without_repeats(text), find) if share >= DOUBTFUL_SHARE else share


def _marks(text: str, n: int) -> np.ndarray:
    """Which of the n tokens of a text are followed by a mark of sentences or records; all lines of a table have one."""
    at = np.array([(m.start(), m.end()) for m in re.finditer(_TOKEN, text, re.I)])
    places = np.array([m.start() for m in _MARK.finditer(text)], int)
    token = np.searchsorted(at[:, 0], places, "right") - 1
    after = (token >= 0) & (places >= at[token, 1])  # marks inside links are none
    marks = np.zeros(n, bool)
    marks[token[after]] = True
    lines = [x for x in text.split("\n") if x.strip()]
    columns = {len(re.findall(r"[|\t]", x)) for x in lines}
    return np.ones(n, bool) if len(lines) > 2 and len(columns) == 1 and 0 not in columns else marks


_WORD, _FUNCTION, _NUMBER, _LINK, _TAG = range(5)
_KNOWN_MOST = 1_000_000
_known: dict[str, int] = {}


def _code(token: str) -> int:
    """Kind of a token and, above it, a number that equal words share; remembered by each Python worker."""
    if len(_known) > _KNOWN_MOST:
        _known.clear()
    low = token.lower()
    if token[0] in "[<" or token[:4] in ("http", "www."):
        return _LINK  # not remembered
    if token[0] == "#":
        return _TAG
    if low in FUNCTION_WORDS:
        kind = _FUNCTION
    elif not low.isalpha() and any(c.isdigit() for c in low):
        kind = _NUMBER
    else:
        kind = _WORD
    code = kind | ((hash(low) >> 4) << 3)
    if len(token) < 40:
        _known[token] = code
    return code


def _share(text: str, find) -> float:
    tokens = find(text)
    n = len(tokens)
    if n < LEAST_TOKENS:
        return 0.0
    get = _known.get
    codes = np.array([get(t) or _code(t) for t in tokens], np.int64)
    kinds = codes & 7
    word, function, number, link, tag = (kinds == k for k in range(5))
    ids = np.where(kinds < _LINK, codes >> 3, -np.arange(1, n + 1))
    # "de" joins the nouns of a keyword
    if "de" in tokens or "De" in tokens:
        function[1:-1] &= ~(word[:-2] & word[2:] & np.array([t in ("de", "De") for t in tokens[1:-1]], bool))
    # distance of each token to the nearest equal one before or after
    order = np.argsort(ids, kind="stable")
    never = 1 << 30
    gap = np.where(ids[order][1:] == ids[order][:-1], np.diff(order), never)
    nearest = np.full(n, never)
    nearest[order[1:]] = gap
    nearest[order[:-1]] = np.minimum(nearest[order[:-1]], gap)
    linked = link | tag
    listed_word = linked | word & (nearest <= LIST_GAP)
    width = min(n, WINDOW)
    low = _windows(n, width)
    functions, numbers = _around(function, low, width), _around(number, low, width)
    unique = np.zeros(n, bool)
    if n >= WINDOW:
        unique = (functions <= UNIQUE_FUNCTION_WORDS) & (numbers <= UNIQUE_NUMBERS)
        if unique.any():
            unique &= _around(word & (nearest >= WINDOW), low, width) >= UNIQUE_WORDS
        if unique.any():
            unique &= _around(_marks(text, n), low, width) <= UNIQUE_MARKS
    if not (unique.any() or listed_word.any()):
        return 0.0
    dense, bare = _around(linked | word & (nearest <= GAP), low, width), _around(listed_word, low, width)
    listed = (dense >= LIST_DENSE) & (functions <= LIST_FUNCTION_WORDS) | (bare >= LIST_DENSE) & (functions <= BARE_FUNCTION_WORDS)
    bad = linked | unique | listed & (numbers <= MOST_NUMBERS)
    # words that return within a gap or at a lag are dense, so that only these places can be stuffed
    open_ = ~bad & (dense >= STUFFED_DENSE) & (functions <= STUFFED_FUNCTION_WORDS) & (numbers <= MOST_NUMBERS)
    if open_.any():
        stuffed = _around(word & (nearest <= SHORT_GAP), low, width) >= STUFFED_DENSE
        if (open_ & ~stuffed).any():
            for lag in range(SHORT_GAP + 1, min(LAGS, n - 1) + 1):
                again = np.zeros(n, bool)
                again[lag:] = ids[lag:] == ids[:-lag]
                if np.count_nonzero(again & word) < STUFFED_DENSE * width:
                    continue
                ends = np.flatnonzero(np.diff(again, prepend=False, append=False))
                for a, b in zip(ends[::2], ends[1::2], strict=True):
                    if b - a > PHRASE:
                        again[a:b] = False
                stuffed |= _around(again & word, low, width) >= STUFFED_DENSE
        bad |= open_ & stuffed
    weight = 1 + (LINK_WEIGHT - 1) * link + (TAG_WEIGHT - 1) * tag
    return float((bad * weight).sum() / weight.sum())


def spam_scores(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, unnatural): the share of each text that is unnatural; all rows are kept.

    Null, empty and very short texts get 0.  Repeated rows get a row each, and
    columns of other names are dropped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = re.compile(_TOKEN, re.I).findall
        for b in batches:
            if len(b):
                yield pd.DataFrame({id_col: b[id_col], "unnatural": [unnatural_share(t, find) for t in b[text]]})

    return df.select(F.col(id_col), F.col(text)).mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, unnatural double")


def spam_pages(df: DataFrame, id_col: str = "doc_id", text: str = "text", share: float = SPAM_SHARE) -> DataFrame:
    """(id) of the texts that are for the most part unnatural."""
    return spam_scores(df, id_col, text).where(F.col("unnatural") >= share).select(id_col)
