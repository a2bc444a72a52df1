"""Personal information inside free text (problem 2).

Items with a form of their own (addresses of mail and places, phone and identity
numbers) are found by their form.  Names have none, so the corpus tells which
terms reveal a protected entity:

* disclosure of a term = log2 of how much more likely the term is in the names of
  protected entities (a roster) than in the free text;
* terms that the roster doesn't hold are judged by co-occurrence: log2 of how much
  more often the term stands beside a revealing first name than terms do on average.

Terms over the thresholds are revealing; spans of names grow from them by the
grammar of names, and every item is generalised to a typed placeholder.

All of this is done once for each distinct text.  Look-alike characters are folded
first and spans are mapped back to the text as it stands.

    texts -> (text, term) -> counts ⟗ roster terms -> first-level terms
    texts + their first-level terms -> neighbours -> second-level terms
    texts + their revealing terms -> spans
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskweave.llm.skeleton import form_with_offsets
from maskweave.session import staged

#: Bits from which a term reveals a protected entity, by the roster and by co-occurrence.
ROSTER_BITS, NEIGHBOUR_BITS = 0.5, 1.0
#: A word beside a first name that the corpus holds at most so often is taken for a surname: a share of all its words, or
#: in small corpora a few places.
RARE_SHARE, RARE = 1e-6, 3
#: At most so many terms are so frequent that they are told by a broadcast list instead of a shuffle.
HOT_TERMS_MOST = 10_000

_FLUSH_ROWS = 100_000
KINDS = ("EMAIL", "PHONE", "ID", "ADDRESS", "PERSON")
# Words of the grammar of names and addresses.
PARTICLES = frozenset("von van der den de del della la las los du di da dos zu zum zur ten ter le af y".split())
TITLES = frozenset("mr mrs ms miss dr prof sir herr frau mme mlle m sr sra dr".split())
_TYPES = "Street|Str|St|Avenue|Ave|Av|Boulevard|Boul|Blvd|Road|Rd|Lane|Ln|La|Drive|Drv|Dr|Court|Crt|Ct|Square|Sq|Terrace|Terr|Ter|Crescent|Cres|Cr|Place|Pl|Way|Close|Row|Gardens|Grove|Park"
_UP = "A-ZÀ-ÖØ-Þ"
_WORD = rf"[{_UP}][\w'’-]*"
_NUM = r"\d{1,4}(?: ?[A-Za-z](?![\w.'’]))?(?![\w-])"
_LINK = r"(?:(?:de la|de las|de los|del|des|du|de|d['’]|l['’]|de l['’]|la|le|les|los|las|aux?)\s?)*"
_STREET = (
    rf"(?:{_NUM},? {_WORD}(?: {_WORD})? (?:{_TYPES})\b\.?"
    rf"|{_NUM},? (?:rue|avenue|place|boulevard|quai|chemin|impasse|allée|cours|route) {_LINK}{_WORD}(?: {_WORD})*"
    rf"|(?:Calle|C/|C\.|Avenida|Avda\.?|Plaza|Paseo|Camino|Via|Viale|Rua) {_LINK}{_WORD}(?: {_WORD})*,? {_NUM}"
    rf"|{_WORD}?(?:straße|strasse|str\.?|weg|allee|platz|gasse|ring|damm|ufer) {_NUM}"
    rf"|{_WORD}[ -](?:Straße|Strasse|Str\.|Weg|Allee|Platz|Gasse) {_NUM})"
)
_UNIT = r"(?:(?:Unit|Apt|Flat|Suite|Apartment|Room|No)\b\.? ?#?\w{1,5}, ?)?"
_TAIL = rf"(?:,? ?\b(?:\d{{5}}(?: (?P<t1>{_WORD}))?|(?<=, )(?P<t2>{_WORD})(?: \d{{5}}(?!\d))?))?"
_ADDRESS = re.compile(rf"(?<![\w-]){_UNIT}{_STREET}{_TAIL}")
_HOST = r"(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot ))+[a-z]{2,}"
_EMAIL = re.compile(rf"(?<![\w.+-])[\w](?:[\w.+-]*[\w])?(?:@|\s?(?:\(at\)|\[at\]|\(@\))\s?){_HOST}(?![\w-])", re.I)
_SPOKEN = re.compile(r"(?<![\w.+-])([\w](?:[\w.+-]*[\w])?) at ((?:[a-z0-9-]+\.)+[a-z]{2,})(?![\w-])", re.I)
_BEFORE_AT = frozenset("reached mail look see found available is write contact me us him her back online".split())
_PHONE = re.compile(
    r"(?<![\w+.-])(?:\+\d{1,3}(?:[ .-]?\(\d{1,5}\))?(?:[ .-]?\d){6,13}|\(\d{2,5}\) ?\d{3,4}[ .-]\d{3,4}|\d{3}([.-])\d{3}\1\d{4}|\d{3} \d{3} \d{4}|0\d{2,4} \d{3,4} \d{3,4})(?![\w-]|[.,]\d)"
)
_ID = re.compile(
    r"(?<![\w.-])(?:\d{3}([- ])\d{2}\1\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|\d{2} \d{3} \d{3} \d{3}|\d{3}\.\d{3}\.\d{3}-\d{2})(?![\w-]|\.\d)"
)
_NUMBERED = re.compile(r"(?i:\b(?:passport|identity number|id number|ssn|tax id|steuernummer|steuer-id|social security number)\b)(?: (?:no\.?|number|nr\.?))?:? (?=[A-Z0-9 -]*\d)([A-Z0-9](?:[A-Z0-9]|[ -](?=[A-Z0-9]*\d)){5,16}[A-Z0-9])(?![\w-])")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def fold(word: str) -> str:
    """Lower case without accents."""
    word = unicodedata.normalize("NFKD", word.replace("ß", "ss").lower().replace("’", "'"))
    return "".join(c for c in word if not unicodedata.combining(c))


def _terms(text: str) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words of a folded text."""
    return [(fold(m[0]), m.start(), m.end()) for m in _TOKEN.finditer(text)]


def formal_items(text: str, roles: dict[str, str]) -> list[tuple[int, int, str]]:
    """Items found by form, in a folded text, without overlaps."""
    out: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if b > a and all(b <= x or y <= a for x, y, _ in out):
            out.append((a, b, kind))

    for m in _EMAIL.finditer(text):
        add(m.start(), m.end(), "EMAIL")
    m = _SPOKEN.search(text)
    while m:  # "Oliver at o.kelen at host.example": a refused beginning may hide a true one
        sure = re.search(r"[\d._+-]", m[1]) or not (m[1][0].isupper() or fold(m[1]) in _BEFORE_AT)
        if sure and not text[m.end() : m.end() + 4] == " at ":
            add(m.start(), m.end(), "EMAIL")
            m = _SPOKEN.search(text, m.end())
        else:
            m = _SPOKEN.search(text, m.end(1))
    for m in _ID.finditer(text):
        add(m.start(), m.end(), "ID")
    for m in _PHONE.finditer(text):
        add(m.start(), m.end(), "PHONE")
    for m in _NUMBERED.finditer(text):
        add(m.start(1), m.end(1), "ID")
    for m in _ADDRESS.finditer(text):
        end = m.end()
        for t in ("t1", "t2"):
            if m[t] and roles.get(fold(m[t])) == "G":  # a first name after the comma is no town
                end = m.start(t)
                while end and text[end - 1] in ", ":
                    end -= 1
        if end == m.end() and text[end - 1] == ".":  # with nothing after it, a full stop ends the sentence
            end -= 1
        add(m.start(), end, "ADDRESS")
    return out


def _neighbours(text: str, roles: dict[str, str]) -> Iterator[tuple[str, int, int]]:
    """(term, beside, 1) of the capitalised words: whether each stands beside a revealing first name."""
    words = _terms(text)
    for i, (t, a, b) in enumerate(words):
        if not text[a].isupper() or b - a < 3:
            continue
        j = i - 1
        while j >= 0 and (words[j][0] in PARTICLES or len(words[j][0]) == 1) and re.fullmatch(r"\.? ", text[words[j][2] : words[j + 1][1]]):
            j -= 1
        before = j >= 0 and roles.get(words[j][0]) == "G" and re.fullmatch(r" ", text[words[j][2] : words[j + 1][1]])
        after = i + 1 < len(words) and roles.get(words[i + 1][0]) == "G" and text[b : words[i + 1][1]] == ", "
        yield t, int(bool(before or after)), 1


def person_spans(text: str, roles: dict[str, str], taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans of names in a folded text.

    roles: G for a revealing first name, S for another revealing term, R for a
    rare one; other words are frequent and reveal nothing.
    """
    chars = list(text)
    for a, b, _ in taken:
        chars[a:b] = "\x00" * (b - a)
    masked = "".join(chars)
    words = _terms(masked)
    n = len(words)
    gap = [masked[words[i][2] : words[i + 1][1]] for i in range(n - 1)] + [""]
    role = [roles.get(w[0], "N" if len(w[0]) > 1 else "R") for w in words]
    upper = [masked[w[1]].isupper() for w in words]
    initial = [len(w[0]) == 1 and masked[w[1]].isupper() and masked[w[2] : w[2] + 1] == "." for w in words]
    out: list[tuple[int, int]] = []

    def surname(i: int, like: int) -> int:
        """End (exclusive, in words) of a surname that starts at word i, or i if there is none."""
        j = i
        while j < n and (words[j][0] in PARTICLES or words[j][0] in ("o", "mc")) and not upper[j] and gap[j] == " ":
            j += 1
        if j >= n or initial[j]:
            return i
        known = role[j] in ("S", "G")
        rare = role[j] == "R"
        if upper[j] and len(words[j][0]) > 1 and (known or rare) or not upper[j] and not upper[like] and (role[j] == "S" or rare and j == i):
            j += 1
            while j < n and gap[j - 1] == "-" and upper[j] and len(words[j][0]) > 1:
                j += 1
            return j
        return i

    i = 0
    while i < n:
        start, end = i, i
        if role[i] == "G":
            # first names, initials, surname
            j = i + 1
            while j < n and gap[j - 1] == "-" and role[j] == "G":
                j += 1
            while j < n and gap[j - 1] in (" ", ". ", ".") and initial[j]:
                j += 1
            glue = gap[j - 1]
            ok = glue == " " or initial[j - 1] and glue in (". ", ".")
            s = surname(j, i) if ok else j
            end = s if s > j else j
            if not upper[i] and s == j:
                end = i  # a first name in small letters needs its surname
            if end > i and end < n and gap[end - 1] == "-" and upper[end] and s == j:
                end = i + 1
        elif initial[i]:
            j = i + 1
            while j < n and gap[j - 1] in (".", ". ") and initial[j]:
                j += 1
            if j < n and gap[j - 1] in (". ", "."):
                s = surname(j, i)
                end = s if s > j else i
        elif upper[i] and len(words[i][0]) > 2 and role[i] in ("S", "R"):
            # surname, first name
            s = surname(i, i)
            if s > i and s < n and gap[s - 1] == ", " and (role[s] == "G" or initial[s] and role[s - 1] == "S"):
                j = s + 1
                while j < n and (gap[j - 1] in (" ", ". ", ".") and initial[j]):
                    j += 1
                # "A. Name, First Other" is two names
                follows = j < n and gap[j - 1] == " " and surname(j, s) > j and upper[j]
                end = i if follows else j
            elif i and words[i - 1][0] in TITLES and gap[i - 1] in (" ", ". "):
                end = s
            elif s < n and role[i] == "S" and gap[s - 1] == " " and role[s] == "G" and masked[words[i][1] : words[i][2]].isupper():
                end = s + 1
        if end > start:
            a, b = words[start][1], words[end - 1][2]
            if initial[end - 1]:
                b += 1
            around = masked[max(0, a - 3) : a], masked[b : b + 3]
            if "& " in around[0] or around[1].startswith(" &"):
                i = end
                continue
            b = b - 2 if re.search(r"['’]s$", masked[a:b]) else b
            out.append((a, b))
            i = end
        else:
            i += 1
    return out


def items(text: str | None, roles: dict[str, str]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal items of a text, in order, as places in the text as it stands."""
    if not text:
        return []
    plain, at = form_with_offsets(text)
    found = formal_items(plain, roles)
    found += [(a, b, "PERSON") for a, b in person_spans(plain, roles, found)]
    out = []
    for a, b, kind in sorted(found):
        end = at[b - 1] + 1
        while end < at[b] and unicodedata.combining(text[end]):
            end += 1
        out.append((at[a], end, kind))
    return out


def masked_text(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    """The text with a typed placeholder in place of each item; equal items of a text get equal numbers."""
    if text is None:
        return None
    numbers: dict[tuple[str, str], int] = {}
    count: Counter[str] = Counter()
    parts, at = [], 0
    for a, b, kind in found:
        key = kind, fold(text[a:b])
        if key not in numbers:
            count[kind] += 1
            numbers[key] = count[kind]
        parts += [text[at:a], f"[{kind}_{numbers[key]}]"]
        at = b
    return "".join([*parts, text[at:]])


def _roles_of(row: object) -> dict[str, str]:
    return dict(x.rsplit(":", 1) for x in row) if row is not None else {}


def disclosure(words: DataFrame, protected: DataFrame, name: str = "name") -> DataFrame:
    """(term, n_text, n_names, n_first, bits): how strongly each term of the names reveals a protected entity.

    Names of the form "Last, First" are turned round.  Null and empty names don't count.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both, first = Counter(), Counter()
            for x in b["name"]:
                x = form_with_offsets(x)[0]
                if "," in x:
                    x = " ".join(reversed(x.split(",", 1)))
                terms = [t for t, _, _ in _terms(x) if len(t) > 1 and t not in PARTICLES and t not in TITLES]
                both.update(terms)
                first.update(terms[:1])
            if both:
                yield pd.DataFrame({"term": list(both), "n_names": list(both.values()), "n_first": [first[t] for t in both]})

    names = protected.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).mapInPandas(split, "term string, n_names long, n_first long")
    names = names.groupBy("term").agg(F.sum("n_names").alias("n_names"), F.sum("n_first").alias("n_first"))
    text = words.groupBy("term").agg(F.sum("n").alias("n_text"))
    all_names, all_text = (max(1, d.agg(F.sum(c)).first()[0] or 0) for d, c in ((names, "n_names"), (text, "n_text")))  # one number each
    bits = F.log2((F.col("n_names") / all_names) / (F.coalesce("n_text", F.lit(0.5)) / all_text))
    return names.join(text, "term", "left").select("term", F.coalesce("n_text", F.lit(0)).alias("n_text"), "n_names", "n_first", bits.alias("bits"))


def _words_of(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, terms, ns = [], [], []
        for b in batches:
            for key, t in zip(b["key"], b["text"], strict=True):
                for term, n in Counter(x for x, _, _ in _terms(form_with_offsets(t)[0]) if len(x) > 1).items():
                    keys.append(key)
                    terms.append(term)
                    ns.append(n)
                if len(keys) >= _FLUSH_ROWS:
                    yield pd.DataFrame({"key": keys, "term": terms, "n": ns})
                    keys, terms, ns = [], [], []
        if keys:
            yield pd.DataFrame({"key": keys, "term": terms, "n": ns})

    return texts.select("key", "text").mapInPandas(run, "key string, term string, n long")


def _marked(texts: DataFrame, words: DataFrame, roles: DataFrame) -> DataFrame:
    """Texts with the roles of their own terms (as many as a text has)."""
    marks = words.select("key", "term").join(roles, "term").groupBy("key").agg(F.collect_list(F.concat_ws(":", "term", "role")).alias("roles"))
    return texts.join(marks, "key", "left")


def find_items(rows: DataFrame, protected: DataFrame, text: str = "text", name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(keyed rows, spans): rows with the ``key`` of their text, and (key, spans) for each distinct text with items.

    rows keep their other columns.  Null and empty texts have no key.
    """
    rows = rows.withColumn("key", F.when(F.length(text) > 0, F.base64(F.unhex(F.md5(F.col(text))))))
    texts = staged(rows.where("key is not null").select("key", F.col(text).alias("text")).dropDuplicates(["key"]), "pii-texts")
    words = staged(_words_of(texts), "pii-words")
    known = staged(disclosure(words, protected, name), "pii-disclosure")
    by_roster = known.where(F.col("bits") >= ROSTER_BITS).select("term", F.when(F.col("n_first") * 2 >= F.col("n_names"), "G").otherwise("S").alias("role"))

    counts = staged(words.groupBy("term").agg(F.sum("n").alias("n")), "pii-terms")
    total = counts.agg(F.sum("n")).first()[0] or 0  # one number
    # the rows of terms that stand everywhere are not shuffled by term, unless such a term is in the roster
    hot = counts.where(F.col("n") >= max(total / HOT_TERMS_MOST, RARE + 1)).join(known, "term", "left_anti").select("term")
    few = words.join(F.broadcast(hot), "term", "left_anti")  # at most HOT_TERMS_MOST terms

    def beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            near, all_ = Counter(), Counter()
            for t, r in zip(b["text"], b["roles"], strict=True):
                for term, yes, one in _neighbours(form_with_offsets(t)[0], _roles_of(r)):
                    near[term] += yes
                    all_[term] += one
            if all_:
                yield pd.DataFrame({"term": list(all_), "near": [near[t] for t in all_], "n": list(all_.values())})

    pairs = _marked(texts, few, by_roster.where("role = 'G'")).select("text", "roles").mapInPandas(beside, "term string, near long, n long")
    pairs = staged(pairs.groupBy("term").agg(F.sum("near").alias("near"), F.sum("n").alias("n")), "pii-neighbours")
    base = pairs.agg(F.sum("near") / F.sum("n")).first()[0] or 1.0  # one number
    gain = F.log2((F.col("near") / F.col("n")) / F.lit(base))
    by_neighbour = pairs.where((F.col("near") > 0) & (gain >= NEIGHBOUR_BITS)).select("term", F.lit("S").alias("role"))
    by_neighbour = by_neighbour.join(by_roster, "term", "left_anti")
    revealing = by_roster.unionByName(by_neighbour)
    # rare terms; the rest of the vocabulary is frequent, reveals nothing and goes nowhere
    rare = counts.where(F.col("n") <= F.greatest(F.lit(RARE), F.lit(RARE_SHARE * total))).join(revealing, "term", "left_anti").select("term", F.lit("R").alias("role"))
    roles = staged(revealing.unionByName(rare), "pii-roles")

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [items(t, _roles_of(r)) for t, r in zip(b["text"], b["roles"], strict=True)]
            out = pd.DataFrame({"key": b["key"], "text": b["text"], "got": got})
            out = out[out["got"].map(len) > 0]
            if out.empty:
                continue
            yield pd.DataFrame(
                {
                    "key": out["key"],
                    "spans": out["got"].map(lambda g: [{"start_pos": a, "end_pos": e, "pii_type": k} for a, e, k in g]),
                    "masked": [masked_text(t, g) for t, g in zip(out["text"], out["got"], strict=True)],
                }
            )

    schema = "key string, spans array<struct<start_pos:int,end_pos:int,pii_type:string>>, masked string"
    by_neighbour_hot = roles.join(hot, "term", "left_semi").limit(1).count() > 0  # a term that stands everywhere and beside first names
    found = _marked(texts, words if by_neighbour_hot else few, roles).select("key", "text", "roles").mapInPandas(spans, schema)
    return rows, staged(found, "pii-spans")


def personal_items(rows: DataFrame, protected: DataFrame, ids: list[str], text: str = "text", name: str = "name") -> DataFrame:
    """(ids…, start_pos, end_pos, pii_type): one row for each personal item of each row; repeated rows have theirs each."""
    keyed, found = find_items(rows.select(*ids, F.col(text).alias("text")), protected, "text", name)
    return keyed.select(*ids, "key").join(found.select("key", F.explode("spans").alias("s")), "key").select(*ids, "s.start_pos", "s.end_pos", "s.pii_type")


def sanitised(rows: DataFrame, protected: DataFrame, ids: list[str], text: str = "text", name: str = "name") -> DataFrame:
    """(ids…, text): every row with typed placeholders in place of its items; null and empty texts stay as they are."""
    keyed, found = find_items(rows.select(*ids, F.col(text).alias("text")), protected, "text", name)
    return keyed.join(found.select("key", "masked"), "key", "left").select(*ids, F.coalesce("masked", "text").alias("text"))
