"""Variant spellings of names within a document (problem 6).

1. ``parse``     cuts a value into words, initials and legal form; titles, possessive
                 endings, case, accents and look-alike letters are taken away.
2. vectors       character 3-grams of the padded words, weighted by the inverse
                 frequency over all values of the corpus; grams are counted in a
                 fixed number of buckets, so the counts have a proven size.
3. join          the sparse product of the vectors of a document, gram by gram; every
                 pair that reaches the threshold is kept, whatever the number of
                 partners.  Copies meet as one value.  The values of a document
                 meet in one row; those of a document with more than ROW_VALUES are
                 joined instead, with the same result.
4. veto          an exact check of the words: relatives share a surname, companies a
                 first word, and differ in the rest.  Nicknames are learned from the
                 corpus; two words that are both frequent are no misspellings of each
                 other.
5. clustering    average linkage of full names inside each connected component; then
                 initials, then single words join the one cluster they fit, or the
                 one that their base form names.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.llm.skeleton import form
from maskweave.session import staged, unstaged

#: Least cosine of two values that are compared word by word.
COSINE = 0.2
#: Least average similarity at which clusters of full names are merged.
LINKAGE = 0.08
#: Similarities are summed up as whole numbers of this many parts, so that their order makes no difference.
PARTS = 10**9
#: Documents with more distinct values than this are never brought into one row; they go by joins, with the same result.
ROW_VALUES = 1_000
#: Buckets in which grams are counted: at most so many numbers are broadcast, whatever the corpus holds.
GRAM_BUCKETS = 1 << 18
#: Two values that have more words than this on either side which the other lacks differ in more than spelling.
MOST_OTHER_WORDS = 8
#: A word is taken for a misspelling of another one if it stands in fewer documents than REAL_WORD_DOCS,
#: or in fewer than one for each REAL_WORD_SHARE of the other's.
REAL_WORD_DOCS, REAL_WORD_SHARE = 4, 40
#: A nickname is learned from at least so many places that show it, or documents in which the two stand before one
#: surname; then they must make up that share of all such pairs of the rarer one, since relatives' names are mixed.
NICKNAME_PLACES, NICKNAME_SHARE = 2, 0.35

# Titles, name particles and legal forms.
TITLES = frozenset("mr mrs ms miss dr prof sir herr frau hr fr mme mlle m sr sra srta don dona senor senora monsieur madame".split())
PARTICLES = frozenset("de del della der den di da do dos du la le las los van von zu zum zur the and und y et".split())
LEGAL = {
    "gmbh": "gmbh", "ag": "ag", "aktiengesellschaft": "ag", "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "co": "co", "company": "co", "ltd": "ltd", "limited": "ltd",
    "sa": "sa", "llc": "llc", "plc": "plc", "kg": "kg", "se": "se", "sarl": "sarl", "bv": "bv", "nv": "nv", "oy": "oy", "ab": "ab", "spa": "spa", "srl": "srl", "llp": "llp",
}
# Nicknames that share no beginning with the name, to start from; the others are learned.
NICKNAMES = (
    "abigail abby, alexander sandy, andrew andy, andrew drew, anthony tony, barbara babs, beatrice trixie, beatrix trixie, charles chuck, christopher kit, daniel danny, deborah debbie, dorothy dot, dorothy dottie, "
    "edward ned, edward ted, eleanor ellie, eleanor nell, eleanor nora, elizabeth beth, elizabeth betty, elizabeth libby, elizabeth liz, elizabeth lizzie, francis frank, francisco paco, francisco pancho, frederick freddie, "
    "friederike rike, gerard gerry, heinrich heinz, heinrich heiner, henry hal, henry hank, henry harry, imogen immy, james jamie, james jim, james jimmy, jennifer jenny, johannes hans, john jack, jose pepe, joseph joe, "
    "joseph joey, joseph pepe, judith judy, katharina kathe, katharina trina, katherine kate, katherine kathy, katherine katie, katherine kitty, margaret maggie, margaret meg, margaret peggy, mary molly, mary polly, "
    "michael mick, michael mike, nicholas nicky, oliver ollie, patricia patty, patricia tricia, patricia trish, rebecca becca, rebecca becky, richard dick, richard rick, richard ricky, robert bob, robert bobby, samuel sammy, "
    "sarah sally, stephen steve, susan sue, susan susie, tabitha tabby, theodore ted, theodore teddy, thomas tommy, timothy timmy, victoria tori, victoria vicky, william bill, william billy, william liam"
)
_SPLIT_FORMS = ((r"\bg\.?\s?m\.?\s?b\.?\s?h\b\.?", " gmbh "), (r"\bgesellschaft\s+mbh\b", " gmbh "), (r"\bs\.\s?a\b\.?|\bs\s+a\s*[).]*\s*$", " sa "), (r"\ba\.\s?g\b\.?|\ba\s+g\s*[).]*\s*$", " ag "))
_CAMEL = re.compile(r"(?<=[a-zß-ÿ])(?<!Mc)(?<!Mac)(?<!De)(?<!La)(?=[A-ZÀ-Þ][a-zß-ÿ])")


_UMLAUTS = re.compile(r"([aou])e")


def fold(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss").lower())
    return "".join(c for c in text if not unicodedata.combining(c))


@functools.lru_cache(maxsize=100_000)
def parse(text: str | None) -> str | None:
    """A value's signature ``words|initials|legal|flag``, or null if it holds no name.

    words are sorted, initials in order.  flag: P for what only persons have
    (title, possessive), O for what only organisations have (legal form, &, the),
    A for an acronym.  Numbers are words.  Null for addresses of mail (@) and
    links, and for what has no word of letters.
    """
    if not text:
        return None
    t = form(text)
    if "@" in t or "://" in t:
        return None
    t = t.strip(" \t\n\r.,;:\"'`«»“”")
    flag = ""
    t, owned = re.subn(r"(?<=\w)['’]s$|(?<=s)['’]$", "", t)
    bare = t.replace(".", "")
    if re.fullmatch(r"[A-Z]{3,5}", bare) and not re.search(r"[aeiouäöü]{2}", bare.lower()[1:4] if len(bare) > 4 else ""):
        return f"{bare.lower()}|||A"
    nick = re.search(r"\(([^\W\d]+)\)", t)
    t = _CAMEL.sub(" ", t)
    low = fold(t)
    for pattern, to in _SPLIT_FORMS:
        low = re.sub(pattern, to, low)
    if "&" in low or re.match(r"the\s", low):
        flag = "O"
    words, initials, legal = [], [], ""
    raw = re.findall(r"[^\W_]+", low)
    titled = False
    for i, w in enumerate(raw):
        if w in TITLES and i == 0 and len(raw) > 1 and len(w) > 1:
            titled = True
        elif w in LEGAL and i:
            legal = LEGAL[w]
        elif w in PARTICLES:
            continue
        elif len(w) == 1 and not w.isdigit():
            initials.append(w)
        else:
            words.append(w)
    if nick and len(words) > 2 and not legal and fold(nick[1]) in words:
        words.remove(fold(nick[1]))  # Katharina (Käthe) S.
    if not words or not any(re.search(r"[^\W\d_]", w) for w in words):
        return None
    if legal:
        flag = "O"
    elif titled or owned:
        flag = "P"
    return f"{' '.join(sorted(words))}|{''.join(initials)}|{legal}|{flag}"


@functools.lru_cache(maxsize=100_000)
def nicknames_of(text: str | None, base: str | None) -> list[tuple[str, str]]:
    """Pairs of first names that a value shows: Joseph (Joe) B., or Danny H. with the base form Daniel H."""
    out = []
    t = form(text) if text else ""
    m = re.match(r"\W*([^\W\d_]{2,})\s+\(([^\W\d_]{2,})\)\s+\w", t)
    if m:
        out.append((fold(m[1]), fold(m[2])))
    a, b = parse(text), parse(base)
    if a and b and a != b:
        (wa, ia, la, _), (wb, ib, lb, _) = a.split("|"), b.split("|")
        x, y = set(wa.split()), set(wb.split())
        if len(x) == len(y) == 2 and not ia and not ib and not la and not lb and len(x & y) == 1:
            (p,), (q,) = x - y, y - x
            if _distance(p, q, 3) > 2:
                out.append((p, q))
    return [tuple(sorted(p)) for p in out if p[0] != p[1]]


def _distance(a: str, b: str, most: int) -> int:
    """Edits with swaps of neighbours; anything above ``most`` counts as most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most and (before is None or min(last) > most):
            return most + 1
        before, last = last, row
    return last[-1]


def _typo(a: str, b: str, docs: dict[str, int]) -> bool:
    n = min(len(a), len(b))
    if n < 3 or not (a.isalpha() and b.isalpha()):  # numbers differ in any digit
        return False
    if _UMLAUTS.sub(r"\1", a) == _UMLAUTS.sub(r"\1", b):
        return True
    few, many = sorted((docs.get(a, 0), docs.get(b, 0)))
    if few >= REAL_WORD_DOCS and few * REAL_WORD_SHARE >= many:
        return False
    return _distance(a, b, 2) <= (0 if n < 4 else 1 if n < 7 else 2)


def _shortened(a: str, b: str) -> bool:
    """tech for technologies, mfg for manufacturing, labs for laboratories, fred for frederick."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < 2 or a[0] != b[0] or len(a) == len(b):
        return False
    if len(a) >= 3 and b.startswith(a) or len(a) >= 4 and a[-1] == b[-1] == "s" and b.startswith(a[:-1]):
        return True
    if re.search(r"[aeiou]", a[1:]):
        return False
    rest = iter(b)
    return len(a) >= 3 and all(c in rest for c in a)


def compare(a: str, b: str, docs: dict[str, int]) -> tuple[str, str, str]:
    """(verdict, word, word) of two signatures.

    full: the same full name; init: agreeing but for initials; single: one is a
    single word of the other; nick: the same if the two words are a name and its
    nickname; no: different.
    """
    no = ("no", "", "")
    (wa, ia, la, fa), (wb, ib, lb, fb) = a.split("|"), b.split("|")
    if "A" in (fa, fb):
        if fa == fb:
            return ("full", "", "") if wa == wb else no
        short, (words, legal, flag) = (wa, (wb, lb, fb)) if fa == "A" else (wb, (wa, la, fa))
        return ("single", "", "") if flag != "P" and _acronym(short, words.split(), legal) else no
    if {fa, fb} == {"P", "O"} or la and lb and la != lb:
        return no
    if (fa == "O" and ib) or (fb == "O" and ia):
        return no
    cx, cy = Counter(wa.split()), Counter(wb.split())
    same = (cx & cy).total()
    x, y = list((cx - cy).elements()), list((cy - cx).elements())
    inexact = 0
    if min(len(x), len(y)) > MOST_OTHER_WORDS:
        return no
    for test in (lambda p, q: _typo(p, q, docs), _shortened):
        for w in list(x):
            v = next((v for v in y if test(w, v)), None)
            if v is not None:
                x.remove(w)
                y.remove(v)
                inexact += 1
    # two words written as one
    if len(x) + len(y) == 3 and 1 in (len(x), len(y)):
        one, two = (x, y) if len(x) == 1 else (y, x)
        if one[0] in ("".join(two), "".join(reversed(two))) or min(_distance(one[0], two[0] + two[1], 1), _distance(one[0], two[1] + two[0], 1)) <= 1:
            x, y, same = [], [], same + 2
    matched = same + inexact
    if not matched:
        return no
    if x and y:
        if len(x) == len(y) == 1 and matched == 1 and not la and not lb and "O" not in (fa, fb):
            return ("nick", *sorted((x[0], y[0])))
        return no
    left = x or y  # words that only one of them has
    other_initials = ib if x else ia
    own_initials = ia if x else ib
    if left:
        if matched == 1 and other_initials:  # K.G. Bärwolter and Käthe Bärwolter
            if other_initials[0] not in [w[0] for w in left]:
                return no
            if len(other_initials) > 1 and own_initials and other_initials[1] != own_initials[0]:
                return no
            return ("init", "", "")
        if other_initials and own_initials and other_initials[0] != own_initials[0]:
            return no
        if matched == 1:  # a word alone says little; it may differ by one letter at most
            alone = wb if x else wa
            near = same or any(_distance(alone, w, 1) <= 1 or _shortened(alone, w) for w in (wa if x else wb).split())
            return ("single", "", "") if near else no
        return ("full", "", "")
    if ia and ib and matched == 1:
        k = min(len(ia), len(ib))
        return ("init", "", "") if ia[:k] == ib[:k] else no
    if ia and ib and ia[0] != ib[0]:
        return no
    if matched == 1:
        return ("single", "", "") if ia or ib else ("full", "", "") if not inexact or min(len(wa), len(wb)) > 5 else no
    return ("full", "", "")


def _acronym(short: str, words: list[str], legal: str) -> bool:
    """Whether the letters are the initials of the words in some order, with or without the legal form's."""
    firsts = sorted(w[0] for w in words)
    if len(words) < 2:
        return False
    return sorted(short) == firsts or bool(legal) and sorted(short) == sorted([*firsts, legal[0]])


def is_partial(signature: str) -> bool:
    """Whether a signature is less than a full name: a single word, with or without initials, or an acronym."""
    words, _, _, flag = signature.split("|")
    return flag == "A" or " " not in words


def grams(signature: str) -> list[str]:
    """Features of a signature: 3-grams of its padded words; none for an acronym."""
    words, _, _, flag = signature.split("|")
    return [] if flag == "A" else sorted({f"^{w}$"[i : i + 3] for w in words.split() for i in range(len(w))})


def acronym_keys(signature: str) -> list[str]:
    """The sorted letters of an acronym, or of those that a name of several words may have, with and without the legal form."""
    words, _, legal, flag = signature.split("|")
    if flag == "A":
        return ["".join(sorted(words))]
    firsts = [w[0] for w in words.split()]
    if len(firsts) < 2 or flag == "P":
        return []
    return ["".join(sorted([*firsts, *end])) for end in ([], [legal[0]] if legal else [])[: 1 + bool(legal)]]


_NAME_TYPE = re.compile("PERSON|ORG|COMPANY|INDIRECT|ALIAS", re.I)


def _may_name(text: str | None, type_: str | None) -> bool:
    """Whether a value may be a name: one with digits, / or _ only if its type says so, since numbers, dates and addresses have them too."""
    return bool(text) and (not re.search(r"[\d/_]", text) or bool(type_ and _NAME_TYPE.search(type_)))


def _parsed(df: DataFrame, ids: tuple[str, str], text: str, base: str, type_: str) -> DataFrame:
    entity, doc = ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sig = [parse(x) if _may_name(x, t) else None for x, t in zip(b["text"], b["type"], strict=True)]
            base_sig = [parse(y) if s and is_partial(s) else None for s, y in zip(sig, b["base"], strict=True)]
            nicks = [["~".join(p) for p in nicknames_of(x, y)] if s else [] for s, x, y in zip(sig, b["text"], b["base"], strict=True)]
            out = b.drop(columns=["base"]).assign(sig=sig, base_sig=base_sig, nicks=nicks)
            out = out[out["sig"].notna()]
            if len(out):
                yield out

    kinds = {c: df.schema[c].dataType.simpleString() for c in ids}
    chosen = df.where(F.col(text).isNotNull() & F.col(doc).isNotNull()).select(F.col(entity).alias("entity"), F.col(doc).alias("doc"), F.col(text).alias("text"), F.col(base).alias("base"), F.col(type_).alias("type"))
    return chosen.mapInPandas(run, f"entity {kinds[entity]}, doc {kinds[doc]}, text string, type string, sig string, base_sig string, nicks array<string>")


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) & (GRAM_BUCKETS - 1)


def grams_column(signature: Column) -> Column:
    """The same as ``grams``, and acronyms without any, as an expression."""
    words = F.filter(F.split(F.element_at(F.split(signature, "[|]"), 1), " "), lambda w: w != "")
    cut = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substr(F.concat(F.lit("^"), w, F.lit("$")), i, F.lit(3))))
    return F.when(signature.endswith("|A"), F.array().cast("array<string>")).otherwise(F.array_distinct(F.flatten(cut)))


def gram_counts(values: DataFrame) -> tuple[int, DataFrame]:
    """(number of values, (bucket, df)): in how many values of the corpus the grams of each bucket stand; at most GRAM_BUCKETS rows."""
    bucket = F.crc32(F.col("gram").cast("binary")).bitwiseAND(F.lit(GRAM_BUCKETS - 1)).alias("bucket")
    counts = values.select(F.explode(grams_column(F.col("sig"))).alias("gram")).groupBy(bucket).agg(F.count("*").alias("df"))
    return values.count(), staged(counts, "name-grams")


def similar(values: DataFrame, n: int, counts: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(doc, a, b, cosine): pairs of signatures a < b of a document whose vectors reach the cosine, by joins.

    The product is summed up gram by gram, so no vector has to be in one row.
    """
    bucket = F.crc32(F.col("gram").cast("binary")).bitwiseAND(F.lit(GRAM_BUCKETS - 1))
    exploded = values.select("doc", "sig", F.explode(grams_column(F.col("sig"))).alias("gram")).withColumn("bucket", bucket)
    raw = exploded.join(F.broadcast(counts), "bucket").withColumn("w", F.log1p(F.lit(float(n)) / F.col("df")))  # counts: at most GRAM_BUCKETS rows
    norms = raw.groupBy("doc", "sig").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    v = staged(raw.join(norms, ["doc", "sig"]).select("doc", "sig", "gram", (F.col("w") / F.col("norm")).alias("w")), "name-vectors")
    other = v.select("doc", "gram", F.col("sig").alias("b"), F.col("w").alias("wb"))
    products = v.withColumnRenamed("sig", "a").join(other, ["doc", "gram"]).where("a < b").groupBy("doc", "a", "b").agg(F.sum(F.col("w") * F.col("wb")).alias("cosine"))
    return products.where(F.col("cosine") >= cosine)


def pairs_of(sigs: list[str], weight: Callable[[str], float], cosine: float = COSINE) -> list[tuple[str, str, float]]:
    """The same pairs of one document's signatures, and those of its acronyms."""
    index: dict[str, list[tuple[int, float]]] = defaultdict(list)
    keys: dict[str, list[int]] = defaultdict(list)
    sigs, out, short = sorted(set(sigs)), [], []
    for i, s in enumerate(sigs):
        weights = [(g, weight(g)) for g in grams(s)]
        norm = math.sqrt(sum(w * w for _, w in weights))
        near: dict[int, float] = defaultdict(float)
        for g, w in weights:
            w /= norm
            for j, x in index[g]:
                near[j] += w * x
            index[g].append((i, w))
        out += [(sigs[j], s, c) for j, c in near.items() if c >= cosine]
        if s.endswith("|A"):
            short.append(i)
        else:
            for k in acronym_keys(s):
                keys[k].append(i)
    for i in short:
        for j in {j for k in acronym_keys(sigs[i]) for j in keys[k]}:
            out.append((*sorted((sigs[i], sigs[j])), 0.5))
    return out


def acronym_pairs(values: DataFrame) -> DataFrame:
    """(doc, a, b, cosine): acronyms with the names of their document that they may stand for; they share letters, not grams."""

    @F.pandas_udf("array<string>")
    def keys(s: pd.Series) -> pd.Series:
        return s.map(acronym_keys)

    keyed = values.select("doc", "sig", F.explode(keys("sig")).alias("key"))
    short = F.col("sig").endswith("|A")
    pairs = keyed.where(short).withColumnRenamed("sig", "x").join(keyed.where(~short).withColumnRenamed("sig", "y"), ["doc", "key"])
    return pairs.select("doc", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(0.5).alias("cosine")).distinct()


def _words(values: DataFrame) -> DataFrame:
    """(doc, word, docs): the words of each document's values with the number of documents each stands in."""
    words = staged(values.select("doc", F.explode(F.split(F.element_at(F.split("sig", "[|]"), 1), " ")).alias("word")).distinct(), "name-words")
    return words.join(words.groupBy("word").agg(F.count("*").alias("docs")), "word")


def _judged(pairs: DataFrame, values: DataFrame, words: DataFrame) -> DataFrame:
    """(doc, a, b, cosine, verdict, nick) of the pairs that are not told apart, by joins."""
    mine = values.select("doc", "sig", F.explode(F.split(F.element_at(F.split("sig", "[|]"), 1), " ")).alias("word"))
    # the few words of one value with the number of documents each stands in
    known = staged(mine.join(words, ["doc", "word"]).groupBy("doc", "sig").agg(F.collect_list(F.concat_ws(":", "word", "docs")).alias("known")), "name-known")
    sides = [known.select("doc", F.col("sig").alias(x), F.col("known").alias(f"k{x}")) for x in "ab"]

    @F.pandas_udf("verdict string, x string, y string")
    def judge(a: pd.Series, b: pd.Series, ka: pd.Series, kb: pd.Series) -> pd.DataFrame:
        out = []
        for p, q, u, v in zip(a, b, ka, kb, strict=True):
            counts = {w: int(n) for w, n in (e.rsplit(":", 1) for e in [*u, *v])}
            out.append(compare(p, q, counts))
        return pd.DataFrame(out, columns=["verdict", "x", "y"])

    judged = pairs.join(sides[0], ["doc", "a"]).join(sides[1], ["doc", "b"]).select("doc", "a", "b", "cosine", judge("a", "b", "ka", "kb").alias("j"))
    return judged.select("doc", "a", "b", "cosine", "j.verdict", F.concat_ws("~", "j.x", "j.y").alias("nick")).where("verdict <> 'no'")


def _judged_in_rows(values: DataFrame, words: DataFrame, n: int, counts: DataFrame) -> DataFrame:
    """The same for documents whose values meet in one row."""
    spark = values.sparkSession
    table = np.zeros(GRAM_BUCKETS)
    for r in counts.toLocalIterator():  # at most GRAM_BUCKETS numbers
        table[r.bucket] = r.df
    df = spark.sparkContext.broadcast(table)  # 2 MB
    both = values.select("doc", "sig", F.lit(None).cast("string").alias("known")).unionByName(words.select("doc", F.lit(None).cast("string").alias("sig"), F.concat_ws(":", "word", "docs").alias("known")))
    rows = both.groupBy("doc").agg(F.collect_list("sig").alias("sigs"), F.collect_list("known").alias("known"))  # at most ROW_VALUES values

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights: dict[str, float] = {}

        def weight(gram: str) -> float:
            if gram not in weights:
                weights[gram] = math.log1p(n / max(df.value[_bucket(gram)], 1.0))
            return weights[gram]

        for b in batches:
            out = []
            for doc, sigs, known in zip(b["doc"], b["sigs"], b["known"], strict=True):
                docs = {w: int(k) for w, k in (e.rsplit(":", 1) for e in known)}
                for p, q, c in pairs_of(list(sigs), weight):
                    verdict, x, y = compare(p, q, docs)
                    if verdict != "no":
                        out.append((doc, p, q, c, verdict, f"{x}~{y}"))
            if out:
                yield pd.DataFrame(out, columns=["doc", "a", "b", "cosine", "verdict", "nick"])

    return rows.mapInPandas(run, f"doc {values.schema['doc'].dataType.simpleString()}, a string, b string, cosine double, verdict string, nick string")


def _with_nicknames(judged: DataFrame, nicks: DataFrame) -> DataFrame:
    """(doc, a, b, cosine, verdict) with the pairs that differ in a nickname only, and without those in two first names."""
    sure = judged.where("verdict <> 'nick'").select("doc", "a", "b", "cosine", "verdict")
    maybe = judged.where("verdict = 'nick'")
    # names that stand before one surname far more often together than with others
    seen = maybe.select("doc", "nick").distinct().groupBy("nick").agg(F.count("*").alias("n")).select("nick", "n", F.explode(F.split("nick", "~")).alias("word"))
    totals = seen.groupBy("word").agg(F.sum("n").alias("total"))
    share = seen.join(totals, "word").groupBy("nick").agg(F.max("n").alias("n"), F.min("total").alias("total"))
    learned = share.where((F.col("n") >= NICKNAME_PLACES) & (F.col("n") >= NICKNAME_SHARE * F.col("total"))).select("nick")
    given = maybe.sparkSession.createDataFrame([("~".join(sorted(p.split())),) for p in NICKNAMES.split(",")], "nick string")
    every = nicks.union(learned).union(given).distinct()
    # two nicknames of one name belong together too; the table grows with first names, not with documents
    pair = F.split("nick", "~")
    ends = every.select(F.explode(F.array(F.struct(pair[0].alias("name"), pair[1].alias("x")), F.struct(pair[1].alias("name"), pair[0].alias("x")))).alias("e")).select("e.name", "e.x")
    cousins = ends.join(ends.withColumnRenamed("x", "y"), "name").where("x < y").select(F.concat_ws("~", "x", "y").alias("nick"))
    by_nick = maybe.join(every.union(cousins).distinct(), "nick", "left_semi").select("doc", "a", "b", "cosine", F.lit("full").alias("verdict"))
    return sure.unionByName(by_nick)


def _components(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, sig, comp): connected components by smallest label, each round written to the shared folder."""
    both = edges.select("doc", F.col("a").alias("sig"), F.col("b").alias("other")).unionByName(edges.select("doc", F.col("b").alias("sig"), F.col("a").alias("other")))
    both = staged(both, "name-links")
    labels = staged(both.select("doc", "sig", F.col("sig").alias("comp")).distinct(), "name-comp")
    while True:
        seen = both.join(labels.select("doc", F.col("sig").alias("other"), "comp"), ["doc", "other"]).groupBy("doc", "sig").agg(F.min("comp").alias("near"))
        new = staged(labels.join(seen, ["doc", "sig"]).select("doc", "sig", F.least("comp", "near").alias("comp"), (F.col("near") < F.col("comp")).alias("moved")), "name-comp")
        unstaged(labels)
        if new.where("moved").limit(1).count() == 0:
            unstaged(both)
            return new.select("doc", "sig", "comp")
        # a label's own label is nearer to the end
        jump = new.select("doc", F.col("sig").alias("comp"), F.col("comp").alias("further"))
        labels = staged(new.select("doc", "sig", "comp").join(jump, ["doc", "comp"]).select("doc", "sig", F.col("further").alias("comp")), "name-comp")
        unstaged(new)


def linkage(full: list[str], similarity: dict[str, dict[str, float]]) -> dict[str, list[str]]:
    """Average linkage: the groups of the full names, by their smallest one.

    In each round, every two groups that are each other's nearest are merged.  An
    average never exceeds the larger of its parts, so this gives what merging the
    nearest two of all, one after another, would give; ties go to the smaller names.
    """
    groups = {s: [s] for s in full}
    sums = {a: {b: int(c * PARTS + 0.5) for b, c in similarity.get(a, {}).items() if b in groups} for a in full}
    least = round(LINKAGE * PARTS)
    while True:
        best = {}
        for a, row in sums.items():
            near = [(-x / (len(groups[a]) * len(groups[b])), *sorted((a, b))) for b, x in row.items() if x >= least * len(groups[a]) * len(groups[b])]
            if near:
                best[a] = min(near)
        into = {y: x for _, x, y in best.values() if best.get(x) == best.get(y)}
        if not into:
            return groups
        for y, x in into.items():
            groups[x] += groups.pop(y)
        merged: dict[str, dict[str, int]] = {a: {} for a in groups}
        for a, row in sums.items():
            to = merged[into.get(a, a)]
            for b, x in row.items():
                other = into.get(b, b)
                if other != into.get(a, a):
                    to[other] = to.get(other, 0) + x
        sums = merged


def cluster(values: list[tuple[str, str | None]], edges: list[tuple[str, str, float, str]]) -> dict[tuple[str, str | None], str]:
    """Cluster of every (signature, base signature) of a component, named by its smallest full signature.

    values: (signature, base signature); edges: (a, b, cosine, verdict).
    What fits several clusters and has no base form to tell is left alone.
    ``_large_classes`` gives the same by joins.
    """
    weight: dict[str, dict[str, tuple[float, str]]] = defaultdict(dict)
    for a, b, c, verdict in edges:
        weight[a][b] = weight[b][a] = (c, verdict)
    full = sorted({s for s, _ in values if not is_partial(s)})
    groups = linkage(full, {a: {b: c for b, (c, verdict) in weight[a].items() if verdict == "full"} for a in full})
    of = {s: min(g) for g in groups.values() for s in g}
    members = {min(g): list(g) for g in groups.values()}
    out: dict[tuple[str, str | None], str] = {(s, b): of[s] for s, b in values if s in of}
    for want_initials in (True, False):
        part = sorted({(s, b) for s, b in values if is_partial(s) and bool(s.split("|")[1]) == want_initials}, key=lambda v: (v[0], v[1] or ""))
        fresh: dict[str, list[str]] = defaultdict(list)
        for s, b in part:
            fits = sorted({of[o] for o, (_, verdict) in weight[s].items() if o in of})
            if len(fits) > 1 and b:
                named = [f for f in fits if b in members[f] or any(compare(b, m, {})[0] == "full" for m in members[f])]
                fits = named if len(named) == 1 else fits
            if len(fits) == 1:
                out[s, b] = fits[0]
            elif not fits:
                fresh[s].append(s)
                out[s, b] = s
            else:
                out[s, b] = f"?{s}?{b or ''}"
        # what fits no full name: like with like, through agreeing partial ones
        new = sorted(fresh)
        root2 = {s: s for s in new}
        for s in new:
            for o in weight[s]:
                if o in root2:
                    x, y = root2[s], root2[o]
                    if x != y:
                        low = min(x, y)
                        root2 = {k: low if v in (x, y) else v for k, v in root2.items()}
        for key, c in list(out.items()):
            if c in root2 and key[0] == c:
                out[key] = root2[c]
        for s in new:
            of[s] = root2[s]
            members.setdefault(root2[s], []).append(s)
    return out


def _linkage(full: DataFrame, links: DataFrame) -> DataFrame:
    """(doc, sig, class_sig): ``linkage`` by joins, each round written to the shared folder.

    full: (doc, sig); links: (doc, a, b, cosine) with a < b.
    """
    least = round(LINKAGE * PARTS)
    labels = full.select("doc", "sig", F.col("sig").alias("class_sig"))
    sizes = full.select("doc", F.col("sig").alias("x"), F.lit(1).cast("long").alias("n"))
    sums = links.select("doc", F.col("a").alias("x"), F.col("b").alias("y"), F.floor(F.col("cosine") * PARTS + 0.5).cast("long").alias("s"))
    while True:
        known = sums.join(sizes.withColumnRenamed("n", "nx"), ["doc", "x"]).join(sizes.select("doc", F.col("x").alias("y"), F.col("n").alias("ny")), ["doc", "y"])
        near = known.where(F.col("s") >= least * F.col("nx") * F.col("ny")).select("doc", F.struct((-(F.col("s") / (F.col("nx") * F.col("ny")))).alias("far"), "x", "y").alias("pair"))
        best = near.select("doc", "pair", F.explode(F.array("pair.x", "pair.y")).alias("of")).groupBy("doc", "of").agg(F.min("pair").alias("pair"))
        into = staged(best.groupBy("doc", "pair").agg(F.count("*").alias("times")).where("times = 2").select("doc", F.col("pair.y").alias("y"), F.col("pair.x").alias("into")), "name-merges")
        if into.limit(1).count() == 0:
            return labels
        moved = lambda df, c: df.join(into.withColumnRenamed("y", c), ["doc", c], "left").withColumn(c, F.coalesce("into", c)).drop("into")  # noqa: B023, E731
        before = labels, sizes, sums, into
        labels = staged(moved(labels, "class_sig").select("doc", "sig", "class_sig"), "name-labels")
        sizes = staged(moved(sizes, "x").groupBy("doc", "x").agg(F.sum("n").alias("n")), "name-sizes")
        sums = moved(moved(sums, "x"), "y").where("x <> y").select("doc", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "s")
        sums = staged(sums.groupBy("doc", "x", "y").agg(F.sum("s").alias("s")), "name-sums")
        unstaged(*before)


@F.pandas_udf(T.BooleanType())
def _names_member(base: pd.Series, member: pd.Series) -> pd.Series:
    return pd.Series([b == m or compare(b, m, {})[0] == "full" for b, m in zip(base, member, strict=True)])


_PARTIAL = r"^[^| ]*\||\|A$"


def _large_classes(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, sig, base_sig, class_sig) for documents too large for one row: what ``classes_of`` gives, by joins only."""
    values = rows.select("doc", "sig", "base_sig").distinct()
    values = staged(values.withColumn("partial", F.col("sig").rlike(_PARTIAL)).withColumn("initials", F.element_at(F.split("sig", "[|]"), 2) != ""), "name-large-values")
    both = edges.select("doc", F.col("a").alias("sig"), F.col("b").alias("other")).unionByName(edges.select("doc", F.col("b").alias("sig"), F.col("a").alias("other")))
    full = values.where("not partial").select("doc", "sig").distinct()
    links = edges.where("verdict = 'full'").join(full.withColumnRenamed("sig", "a"), ["doc", "a"], "left_semi").join(full.withColumnRenamed("sig", "b"), ["doc", "b"], "left_semi")
    known = staged(_linkage(full, links), "name-large-classes")
    out = values.join(known, ["doc", "sig"]).select("doc", "sig", "base_sig", "class_sig")
    for with_initials in (True, False):
        part = values.where(F.col("partial") & (F.col("initials") == with_initials)).select("doc", "sig", "base_sig")
        fits = part.select("doc", "sig").distinct().join(both, ["doc", "sig"]).join(known.withColumnRenamed("sig", "other"), ["doc", "other"]).select("doc", "sig", "class_sig").distinct()
        fits = staged(fits, "name-fits")
        number = staged(fits.groupBy("doc", "sig").agg(F.count("*").alias("n"), F.min("class_sig").alias("only")), "name-fitting")
        # several: the one that the base form names
        asked = part.where("base_sig is not null").join(number.where("n > 1"), ["doc", "sig"]).select("doc", "sig", "base_sig").join(fits, ["doc", "sig"])
        told = asked.select("doc", "base_sig", "class_sig").distinct().join(known.withColumnRenamed("sig", "member"), ["doc", "class_sig"])
        told = told.where(_names_member("base_sig", "member")).select("doc", "base_sig", "class_sig").distinct()
        named = asked.join(told, ["doc", "base_sig", "class_sig"], "left_semi").groupBy("doc", "sig", "base_sig").agg(F.count("*").alias("names"), F.min("class_sig").alias("by_base"))
        # none: like with like, through agreeing partial ones
        fresh = staged(part.select("doc", "sig").distinct().join(number, ["doc", "sig"], "left_anti"), "name-fresh")
        among = edges.join(fresh.withColumnRenamed("sig", "a"), ["doc", "a"], "left_semi").join(fresh.withColumnRenamed("sig", "b"), ["doc", "b"], "left_semi")
        alike = fresh.join(_components(fresh, among), ["doc", "sig"], "left").select("doc", "sig", F.coalesce("comp", "sig").alias("own"))
        alike = staged(alike, "name-alike")
        placed = part.join(number, ["doc", "sig"], "left").join(named, ["doc", "sig", "base_sig"], "left").join(alike, ["doc", "sig"], "left")
        unclear = F.concat(F.lit("?"), F.col("sig"), F.lit("?"), F.coalesce("base_sig", F.lit("")))
        chosen = F.when(F.col("n").isNull(), F.col("own")).when(F.col("n") == 1, F.col("only")).when(F.col("names") == 1, F.col("by_base")).otherwise(unclear)
        out = out.unionByName(placed.select("doc", "sig", "base_sig", chosen.alias("class_sig")))
        known = staged(known.unionByName(alike.select("doc", "sig", F.col("own").alias("class_sig"))), "name-large-classes")
    return out


def classes_of(values: list[tuple[str, str | None]], edges: list[tuple[str, str, float, str]]) -> dict[tuple[str, str | None], str]:
    """Class of every (signature, base signature) of a document: ``cluster`` of each connected component."""
    root = {s: s for s, _ in values}

    def top(s: str) -> str:
        while root[s] != s:
            root[s] = root[root[s]]
            s = root[s]
        return s

    for a, b, _, _ in edges:
        root[max(top(a), top(b))] = min(top(a), top(b))
    parts: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
    for v in values:
        parts[top(v[0])][0].append(v)
    for e in edges:
        parts[top(e[0])][1].append(e)
    out: dict[tuple[str, str | None], str] = {}
    for mine, lines in parts.values():
        if lines:
            out |= cluster(mine, lines)
    return out


def name_classes(df: DataFrame, entity: str = "entity_id", doc: str = "doc_id", text: str = "text", base: str = "base_form", type_: str = "type") -> DataFrame:
    """(entity, doc, text, class_sig, type): the class of every row that holds a name.

    Rows with a null document or text and those that hold no name have no row.
    Only rows of one document are compared.  Repeated rows get a row each.
    """
    rows = staged(_parsed(df, (entity, doc), text, base, type_), "names")
    nodes = staged(rows.select("doc", "sig", "base_sig").distinct(), "name-nodes")
    values = staged(nodes.select("doc", "sig").distinct(), "name-values")
    nicks = rows.select("doc", F.explode("nicks").alias("nick")).groupBy("nick").agg(F.countDistinct("doc").alias("places")).where(F.col("places") >= NICKNAME_PLACES).select("nick")
    n, counts = gram_counts(values)
    words = staged(_words(values), "name-word-docs")
    large = staged(values.groupBy("doc").count().where(F.col("count") > ROW_VALUES).select("doc"), "name-large")
    has_large = large.limit(1).count() > 0
    alone = (lambda t: t.join(large, "doc", "left_anti")) if has_large else (lambda t: t)
    hot = lambda t: t.join(large, "doc", "left_semi")
    judged = _judged_in_rows(alone(values), alone(words), n, counts)
    if has_large:
        pairs = similar(hot(values), n, counts).unionByName(acronym_pairs(hot(values)))
        judged = judged.unionByName(_judged(pairs, hot(values), hot(words)))
    judged = staged(judged, "name-judged")
    edges = staged(_with_nicknames(judged, nicks), "name-edges")
    # one row for each document: its values and its edges
    lines = alone(edges).groupBy("doc").agg(F.collect_list(F.struct("a", "b", "cosine", "verdict")).alias("lines"))
    members = alone(nodes).groupBy("doc").agg(F.collect_list(F.struct("sig", "base_sig")).alias("nodes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, v, e in zip(b["doc"], b["nodes"], b["lines"], strict=True):
                got = classes_of([(x["sig"], x["base_sig"]) for x in v], [(x["a"], x["b"], x["cosine"], x["verdict"]) for x in e])
                out += [(d, s, y, c) for (s, y), c in got.items()]
            if out:
                yield pd.DataFrame(out, columns=["doc", "sig", "base_sig", "class_sig"])

    kind = values.schema["doc"].dataType.simpleString()
    clustered = members.join(lines, "doc").select("doc", "nodes", "lines").mapInPandas(run, f"doc {kind}, sig string, base_sig string, class_sig string")
    if has_large:
        clustered = clustered.unionByName(_large_classes(hot(nodes), staged(hot(edges), "name-large-edges")))
    marked = clustered.select("doc", "sig", F.coalesce("base_sig", F.lit("")).alias("b"), "class_sig")
    joined = rows.withColumn("b", F.coalesce("base_sig", F.lit(""))).join(marked, ["doc", "sig", "b"], "left")
    return joined.select(F.col("entity").alias(entity), F.col("doc").alias(doc), F.col("text").alias(text), F.coalesce("class_sig", "sig").alias("class_sig"), F.col("type").alias("type"))


def same_name(df: DataFrame, entity: str = "entity_id", doc: str = "doc_id", text: str = "text", base: str = "base_form", type_: str = "type") -> DataFrame:
    """(<entity>_a, <entity>_b), smaller first: rows of a document that name the same one by different strings."""
    c = staged(name_classes(df, entity, doc, text, base, type_), "name-classes")
    # a word alone without a full name beside it is a name only if its type says so
    alone = ~F.element_at(F.split("class_sig", "[|]"), 1).contains(" ") & ~F.coalesce(F.upper("type"), F.lit("")).rlike(_NAME_TYPE.pattern)
    c = c.where(~alone)
    left = c.select(F.col(doc).alias("d"), "class_sig", F.col(entity).alias("a"), F.col(text).alias("ta"))
    right = c.select(F.col(doc).alias("d"), "class_sig", F.col(entity).alias("b"), F.col(text).alias("tb"))
    return left.join(right, ["d", "class_sig"]).where("a < b AND ta <> tb").select(F.col("a").alias(f"{entity}_a"), F.col("b").alias(f"{entity}_b"))


def name_groups(df: DataFrame, entity: str = "entity_id", doc: str = "doc_id", text: str = "text", base: str = "base_form", type_: str = "type") -> DataFrame:
    """(entity, class_id, n): each row that holds a name with the smallest identifier of its class and the number of rows there."""
    c = staged(name_classes(df, entity, doc, text, base, type_), "name-classes")
    counted = c.groupBy(F.col(doc).alias("_d"), F.col("class_sig").alias("_c")).agg(F.min(entity).alias("class_id"), F.count("*").alias("n"))
    return c.join(counted, (F.col(doc) == F.col("_d")) & (F.col("class_sig") == F.col("_c"))).select(entity, "class_id", "n")
