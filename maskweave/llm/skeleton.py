"""Visually identical text with different characters (problem 1).

``skeleton``  decompose, replace every character by its prototype from the
              look-alike table, decompose again; values that look the same have
              the same skeleton, whatever script they use.  The table is the public
              one of Unicode (confusables), read from the ICU library that Spark
              ships; it covers all scripts, and plain letters that look alike.
``form``      the one consistent form of a value: composed letters, plain
              letters, digits, spaces and hyphens, one script within a word,
              nothing invisible.  Words truly written in another script, accents
              and emoji with their joiners stay as they are.

``inconsistent`` takes its rows from groups of equal skeletons: a value is a case
if it isn't written as its group's consistent form.  Plain ASCII values take no
Python at all, and only those that share a skeleton with another value are joined.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.session import staged

# Letters of other scripts that look like a Latin letter, each line followed by its prototypes.
_CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһѵԁԛԝӏ"
_CYRILLIC_AS = "ABESIJKMHOPCTYXYGQWaesijopcyxhvdqwl"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿαγικνορτυχϲϳ"
_GREEK_AS = "ABEZHIKMNOPTYXCJayikvoptuxcj"
_OTHER = "ɡɑɩօսոԍՏ"
_OTHER_AS = "gaiounGS"
LOOK_ALIKES: dict[str, str] = {**dict(zip(_CYRILLIC, _CYRILLIC_AS, strict=True)), **dict(zip(_GREEK, _GREEK_AS, strict=True)), **dict(zip(_OTHER, _OTHER_AS, strict=True))}
#: Latin letters in a word of another script: the letter of that script they look like (first one listed).
_BACK = {
    "Cyrl": {b: a for a, b in reversed([*zip(_CYRILLIC, _CYRILLIC_AS, strict=True)])},
    "Grek": {b: a for a, b in reversed([*zip(_GREEK, _GREEK_AS, strict=True)])},
}
# Hyphens that look like the plain one.
_HYPHENS = frozenset("\u2010\u2011\u2012\u2043\ufe63\uff0d")
# Characters without a picture of their own; the joiners have a use in some places.
_JOINERS = "\u200c\u200d"
_INVISIBLE = frozenset("\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200e\u200f\u2028\u2029\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff" + _JOINERS)
_SELECTORS = frozenset(map(chr, range(0xFE00, 0xFE10)))

# First code points of the ranges of scripts, in order; "" stands for what needs no care here.
_SCRIPT_STARTS = [
    (0x00, ""), (0x41, "Latn"), (0x5B, ""), (0x61, "Latn"), (0x7B, ""), (0xAA, "Latn"), (0xAB, ""), (0xBA, "Latn"), (0xBB, ""), (0xC0, "Latn"), (0x2B0, ""), (0x370, "Grek"), (0x400, "Cyrl"), (0x530, "Armn"), (0x590, "Join"), (0x1000, ""), (0x1E00, "Latn"),
    (0x1F00, "Grek"), (0x2000, ""), (0x2DE0, "Cyrl"), (0x2E00, ""), (0x2E80, "Cjk"), (0xA640, "Cyrl"), (0xA6A0, ""), (0xA720, "Latn"), (0xA800, ""), (0xAC00, "Cjk"), (0xD7B0, ""), (0xF900, "Cjk"), (0xFB00, ""), (0xFB50, "Join"), (0xFE00, ""), (0x20000, "Cjk"), (0x32000, ""),
]
_STARTS = [a for a, _ in _SCRIPT_STARTS]


def _script(c: str) -> str:
    return _SCRIPT_STARTS[bisect_right(_STARTS, ord(c)) - 1][1]


@functools.lru_cache(maxsize=4)
def _prototypes(jvm: object) -> dict[str, str]:
    points = [chr(i) for i in range(0x21, 0x20000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i))[0] in "LNPS"]
    # one call for all characters, set apart by one that has no look-alike
    made = jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\x01".join(points)).split("\x01")
    return {c: p for c, p in zip(points, made, strict=True) if c != p}


def prototypes(spark: SparkSession) -> dict[str, str]:
    """Character -> prototype of the public look-alike table; its size is bounded by Unicode's.

    Without the ICU library this fails: with the letters of this module alone,
    fewer cases would be found, and that would look like a result.
    """
    try:
        return {**LOOK_ALIKES, **_prototypes(spark.sparkContext._jvm)}
    except (TypeError, Py4JError) as e:  # TypeError: the class isn't there, so its name is a package's
        raise RuntimeError("the table of look-alikes can't be read from the ICU library (com.ibm.icu:icu4j) of this Spark session") from e


def skeleton(text: str, table: dict[str, str] = LOOK_ALIKES) -> str:
    """Decompose, take prototypes, decompose again; invisible characters have no prototype."""
    out = []
    for c in unicodedata.normalize("NFD", text):
        if c in _HYPHENS:
            out.append("-")
        elif c in table:
            out.append(table[c])
        elif c not in _INVISIBLE and c not in _SELECTORS:
            out.append(" " if unicodedata.category(c) == "Zs" else unicodedata.normalize("NFKC", c))
    return unicodedata.normalize("NFD", "".join(table.get(c, c) for c in unicodedata.normalize("NFD", "".join(out))))


def _plain_skeleton(text: Column, table: dict[str, str]) -> Column:
    """The same for printable ASCII, as an expression."""
    plain = {c: skeleton(c, table) for c in map(chr, range(0x20, 0x7F)) if skeleton(c, table) != c}
    single = {c: p for c, p in plain.items() if len(p) == 1}
    out = F.translate(text, "".join(single), "".join(single.values())) if single else text
    for c, p in plain.items():
        if len(p) != 1:
            out = F.replace(out, F.lit(c), F.lit(p))
    return out


def _in_latin_words(form: str, table: dict[str, str]) -> str:
    """The form with letters of rarer scripts that look like Latin ones replaced in words that have Latin letters."""
    strange = {c for c in form if c > "\u02af" and c not in LOOK_ALIKES and c.isalpha() and _script(c) in ("", "Join") and table.get(c, "").isascii() and table.get(c, "").isalpha()}
    if not strange:
        return form
    word = lambda m: "".join(table[c] if c in strange else c for c in m[0]) if any(c.isascii() for c in m[0]) else m[0]
    return re.sub(r"[^\W\d_]+", word, form)


def _pictorial(c: str) -> bool:
    return ord(c) >= 0x2190 and (unicodedata.category(c) in ("So", "Sk") or c in _SELECTORS or c == "\u200d")


def _plain(text: str, i: int) -> str:
    """The character at i without look-alike letters being touched."""
    c = text[i]
    if c < "\x7f":
        return "" if c < " " and c not in "\t\n\r" else c
    before, after = text[i - 1] if i else "", text[i + 1] if i + 1 < len(text) else ""
    if c in _HYPHENS:
        return "-"
    if c in _JOINERS:  # kept inside emoji and inside words of scripts that need them
        inside = before and after and (_pictorial(before) and _pictorial(after) or _script(before) == _script(after) == "Join")
        return c if inside else ""
    if c in _SELECTORS:
        return c if before and (_pictorial(before) or before in "#*0123456789") else ""
    if c in _INVISIBLE:
        return ""
    kind = unicodedata.category(c)
    if kind == "Cc":
        return ""
    near_cjk = any(x and _script(x) == "Cjk" and x != "\u3000" for x in (before, after))
    if kind == "Zs":
        return c if c == "\u3000" and near_cjk else " "
    if c in LOOK_ALIKES or kind[0] not in "LNPS" or near_cjk and kind[0] == "P":
        return c
    as_plain = unicodedata.normalize("NFKC", c)
    return as_plain if kind[0] in "LN" or as_plain.isascii() else c


def _one_script(letters: list[str], near: list[str], latin_text: bool) -> list[str]:
    """The letters of one word in one script; near: the scripts that the words beside it surely have."""
    scripts = [_script(c) if c.isalpha() else "" for c in letters]
    own = {s for s in scripts if s in ("Latn", "Grek", "Cyrl", "Armn")}
    own |= {"Other"} if any(c in _OTHER for c in letters) else set()
    if len(own) < 2 and own <= {"Latn"}:
        return letters
    latin = sum(s == "Latn" for s in scripts)
    sure = {s: sum(x == s and c not in LOOK_ALIKES for x, c in zip(scripts, letters, strict=True)) for s in ("Grek", "Cyrl")}
    main = max(sure, key=lambda s: sure[s])
    if sure[main]:
        if len(own) == 1:
            return letters
        back = _BACK[main]
        if sure[main] >= latin or all(c in back for c, s in zip(letters, scripts, strict=True) if s == "Latn"):
            return [back.get(LOOK_ALIKES.get(c, c), c) if s != main else c for c, s in zip(letters, scripts, strict=True)]
    elif not latin and (own & set(near) or not latin_text):
        return letters  # a word of look-alikes among words of its script
    return [LOOK_ALIKES.get(c, c) for c in letters]


def form_with_offsets(text: str) -> tuple[str, list[int]]:
    """The consistent form and, for each of its characters and its end, the place in the text."""
    if text.isascii() and text.isprintable():
        return text, list(range(len(text) + 1))
    chars: list[str] = []
    at: list[int] = []
    for i in range(len(text)):
        for c in _plain(text, i):
            chars.append(c)
            at.append(i)
    if any(c in LOOK_ALIKES for c in chars):
        words, start = [], None
        for i, c in enumerate([*chars, " "]):
            inside = c.isalpha() or unicodedata.combining(c)
            if inside and start is None:
                start = i
            elif not inside and start is not None:
                words.append((start, i))
                start = None
        sure = []
        for a, b in words:
            s = {_script(c) for c in chars[a:b] if c not in LOOK_ALIKES and c.isalpha()}
            sure.append(s.pop() if len(s) == 1 else "")
        latin_text = "Latn" in sure
        for k, (a, b) in enumerate(words):
            if any(c in LOOK_ALIKES for c in chars[a:b]):
                chars[a:b] = _one_script(chars[a:b], sure[max(0, k - 1) : k] + sure[k + 1 : k + 2], latin_text)
    out: list[str] = []
    places: list[int] = []
    i = 0
    while i < len(chars):
        j = i + 1
        while j < len(chars) and unicodedata.combining(chars[j]):
            j += 1
        composed = unicodedata.normalize("NFC", "".join(chars[i:j]))
        out.append(composed)
        places += [at[i]] * (len(composed) if j > i + 1 or len(composed) > 1 else 1)
        i = j
    return "".join(out), [*places, len(text)]


def form(text: str) -> str:
    """The consistent form of a value."""
    return text if text.isascii() and text.isprintable() else form_with_offsets(text)[0]


def _letters(form: str) -> str:
    """Latin if a form has letters without look-alikes among them, alike if it has none but look-alikes, else empty."""
    letters = [c for c in unicodedata.normalize("NFD", form) if c.isalpha()]
    alike = sum(c in LOOK_ALIKES for c in letters)
    return "" if not letters or 0 < alike < len(letters) else "alike" if alike else "Latin"


_FORMS = "form string, skeleton string, letters string, latin string"


def _forms_udf(spark: SparkSession) -> Callable[..., Column]:
    shared = spark.sparkContext.broadcast(prototypes(spark))  # as large as Unicode's table

    @F.pandas_udf(_FORMS)
    def run(s: pd.Series) -> pd.DataFrame:
        table, out = shared.value, []
        for x in s:
            if x is None:
                out.append((None, None, None, None))
                continue
            f = _in_latin_words(form(x), table)
            out.append((f, skeleton(x, table), _letters(f), "".join(LOOK_ALIKES.get(c, c) for c in f)))
        return pd.DataFrame(out, columns=["form", "skeleton", "letters", "latin"])

    return run


def _plain_and_strange(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows that are their own form, with their skeleton, and the others with ``_f``."""
    plain: Column = F.col(text).rlike(r"^[\x20-\x7e\t\n\r]*$")
    kept = [c for c in df.columns if c not in ("form", "skeleton", "_f")]
    spark = df.sparkSession
    known = df.where(F.col(text).isNull() | plain).select(*kept, F.col(text).alias("form"), _plain_skeleton(F.col(text), prototypes(spark)).alias("skeleton"))
    return known, df.where(~plain).select(*kept, _forms_udf(spark)(F.col(text)).alias("_f"))


def forms(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``form`` and ``skeleton``; both are null for a null text and empty for an empty one.

    Columns of these names are replaced.  Values of printable ASCII are their own
    form and never reach Python.
    """
    known, strange = _plain_and_strange(df, text)
    return known.unionByName(strange.select(*[c for c in strange.columns if c != "_f"], "_f.form", "_f.skeleton"))


def inconsistent(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text is not written as the consistent form of its skeleton's group, with that form and the skeleton.

    Every value that isn't plain meets the Latin values of its group.  Its
    consistent form is its own one (composed, plain, one script), but that of the
    Latin value where all its letters are look-alikes of that value's.  Plain
    values are consistent; of them only those whose skeleton a strange value has
    are grouped.  Null and empty texts are no case.
    """
    known, strange = _plain_and_strange(df, text)
    kept = [c for c in strange.columns if c != "_f"]
    strange = staged(strange, "forms")
    groups = strange.select("_f.skeleton").distinct()
    members = known.select("skeleton", "form").unionByName(strange.where("_f.letters = 'Latin'").select("_f.skeleton", "_f.form"))
    latin = members.join(groups, "skeleton", "left_semi").select("skeleton", F.col("form").alias("latin")).distinct()
    s = strange.select(*kept, "_f.form", "_f.skeleton", F.when(F.col("_f.letters") == "alike", F.col("_f.latin")).alias("latin"))
    found = s.join(latin.withColumn("_in_group", F.lit(True)), ["skeleton", "latin"], "left")
    consistent = F.when(F.col("_in_group"), F.col("latin")).otherwise(F.col("form"))
    return found.withColumn("form", consistent).where(F.col("form") != F.col(text)).select(*kept, "form", "skeleton")


def groups(df: DataFrame, text: str = "text") -> DataFrame:
    """(skeleton, form, originals, n_rows): originals with equal skeletons, under their most frequent form.

    Counted in two levels, by original and then by skeleton, so that a frequent
    value is summed up before it is shuffled.  Ties go to the smaller form.
    """
    counted = forms(df, text).where(F.col(text).isNotNull()).groupBy("skeleton", "form", text).agg(F.count("*").alias("n"))
    by_form = counted.groupBy("skeleton", "form").agg(F.count("*").alias("originals"), F.sum("n").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("form").alias("form")))["form"]
    return by_form.groupBy("skeleton").agg(best.alias("form"), F.sum("originals").alias("originals"), F.sum("n").alias("n_rows"))
