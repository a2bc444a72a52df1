"""Same postal address written differently (problem 5).

1. ``parse``    cuts an address into components: number with its letter, postcode,
                street name, street type, other words; flats, floors and care-of
                details are dropped, since they make no difference to the building.
2. spelling     a deletion-neighbourhood index over the words of all addresses: two
                words that become equal by leaving out one letter each are
                neighbours, and a word yields to a neighbour that is much more
                frequent.  The index holds each distinct word once, and the words of
                a variant differ from it in one letter, so their number is bounded by
                its length, however large the input is.
3. localities   every postcode takes the town that most addresses give with it, so
                an address with either of them gets its locality.
4. assignment   blocks are (locality, number, letter): a different number is a hard
                veto, a different unit too where units count.  Inside a block a second
                deletion-neighbourhood index merges what the corpus could not decide,
                types veto each other, and an address without a type takes the only
                type its street has there.
5. neighbours   localities are neighbours if addresses give them with one postcode.  Two
                buildings of neighbouring localities are one if number, street and
                type agree and both are given with the very same postcode.

Buildings are keys, not lists: no block is ever collected.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskweave.session import staged, unstaged

# Street types and how they are abbreviated.
TYPES = {
    "street": "street st str", "avenue": "avenue ave av", "boulevard": "boulevard boul blvd bvd", "road": "road rd", "lane": "lane ln la", "drive": "drive dr drv",
    "court": "court ct crt", "square": "square sq sqr", "terrace": "terrace terr ter", "crescent": "crescent cres cr", "place": "place pl", "way": "way", "close": "close cl",
    "row": "row", "gardens": "gardens gdns", "grove": "grove grv", "park": "park pk", "parade": "parade pde", "alley": "alley aly",
    "strasse": "strasse", "weg": "weg", "allee": "allee all", "gasse": "gasse", "platz": "platz pl", "ring": "ring", "damm": "damm", "ufer": "ufer",
}
_TYPE_OF = {a: t for t, names in reversed(TYPES.items()) for a in names.split()}
# Endings of one-word streets, longest first, and words that precede the name of a street.
_ENDINGS = (("strasse", "strasse"), ("gasse", "gasse"), ("allee", "allee"), ("platz", "platz"), ("damm", "damm"), ("ring", "ring"), ("ufer", "ufer"), ("str", "strasse"), ("weg", "weg"), ("all", "allee"))
_LEADING = {"calle": "calle", "rue": "rue", "avenida": "avenida", "plaza": "plaza", "paseo": "paseo", "place": "place", "via": "via", "camino": "camino"}
_LEADING_LINKS = frozenset("de del la las los el le les du des d l".split())
# Fillers that stand for no address.
FILLERS = frozenset(["", "unknown", "n a", "na", "none", "null", "tbd", "see file", "no address", "not known", "k a", "unbekannt", "desconocido", "inconnu", "keine"])

_CARE = re.compile(r"\b(?:c/o|care of|z\.? ?hd\.?|attn\.?)\s*\w+")
_FLOOR = re.compile(r"\b\d+\s*(?:\.|st|nd|rd|th)?\s*(?:floor|stock|og|etage|piso|étage)\b|\b(?:ground floor|erdgeschoss|eg|dg|rear building|front building|rear house|hinterhaus|vorderhaus|rear|basement|penthouse)\b")
_UNIT = re.compile(r"\b(?:flat|apt|apartment|appartement|unit|suite|ste|room|rm|fl|floor|lvl|level|whg|wohnung|top|door|piso|puerta|no flat)\b\.?\s*(?:no\.?|nr\.?|#)?\s*(?:\d+\s?[a-z]?|[a-z])\b(?!\s*\d{1,4}[a-z]?\s*$)")
_POST = re.compile(r"\b(\d{5})\b")
_NUMBER = re.compile(r"(?:\b(?:no|nr|num|nº)\b\.?\s*|#\s*)?\b(\d{1,4})(?:\s?([a-z]))?\b(?!\w)")
_WORDS = re.compile(r"[a-z]+|[0-9]+")


def _fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ẞ", "ss").lower())
    return "".join(c for c in text if not unicodedata.combining(c))


def parse(text: str | None) -> tuple[str | None, str | None, str | None, str | None, str, str]:
    """(number with letter, postcode, street name, street type, other words, unit); no number if the text is no address."""
    nothing = (None, None, None, None, "", "")
    if not text:
        return nothing
    f = _fold(text)
    if " ".join(_WORDS.findall(f)) in FILLERS:
        return nothing
    f = _CARE.sub(" , ", f)
    f = _FLOOR.sub(" , ", f)
    unit = _UNIT.search(f)
    unit = re.sub(r"\W", "", re.search(r"(?:\d+\s?[a-z]?|[a-z])\s*$", unit[0])[0]) if unit else ""
    f = _UNIT.sub(" , ", f)
    post = _POST.search(f)
    if post:
        f = f[: post.start()] + " , " + f[post.end() :]
    number = _NUMBER.search(f)
    if not number:
        return nothing
    f = f[: number.start()] + " , " + f[number.end() :]
    words = [w for w in re.findall(r"[a-z]+|,", re.sub(r"\b(?:no|nr)\b\.?|[#;\n]", " , ", f)) if len(w) > 1 or w == ","]
    name = kind = None
    for i, w in enumerate(words):  # Pilgrim Court, Linden-Allee
        if i and w in _TYPE_OF and words[i - 1] != "," and words[i - 1] not in _TYPE_OF:
            name, kind, words = words[i - 1], _TYPE_OF[w], words[: i - 1] + words[i + 1 :]
            break
    else:
        for i, w in enumerate(words):  # Lindenallee, calle de la Fuente
            end = next(((e, t) for e, t in _ENDINGS if w.endswith(e) and len(w) > len(e) + 2), None)
            if end:
                name, kind, words = w[: -len(end[0])], end[1], words[:i] + words[i + 1 :]
                break
            if w in _LEADING:
                j = i + 1
                while j < len(words) and (words[j] in _LEADING_LINKS or j == i + 1 and words[j] != ","):
                    j += 1
                while j < len(words) and words[j] != "," and words[j - 1] in _LEADING_LINKS:
                    j += 1
                name, kind, words = "".join(x for x in words[i + 1 : j] if x not in _LEADING_LINKS) or None, _LEADING[w], words[:i] + words[j:]
                break
    return number[1] + (number[2] or ""), post[1] if post else None, name, kind, " ".join(w for w in words if w != ","), unit


def parsed(df: DataFrame, id_col: str, address: str) -> DataFrame:
    """(rec_id, number, postcode, street, kind, rest, unit) of the rows whose address is one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = pd.DataFrame([parse(x) for x in b["address"]], columns=["number", "postcode", "street", "kind", "rest", "unit"])
            got.insert(0, "rec_id", b["rec_id"].values)
            got = got[got["number"].notna()]
            if len(got):
                yield got

    kind = df.schema[id_col].dataType.simpleString()
    return df.where(F.col(address).isNotNull()).select(F.col(id_col).alias("rec_id"), F.col(address).alias("address")).mapInPandas(
        run, f"rec_id {kind}, number string, postcode string, street string, kind string, rest string, unit string"
    )


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by shuffles, never by a broadcast.

    The planner knows the size of a compressed table, but not what exploding it
    into variants makes of that, and would send much more to the driver than its
    threshold says.
    """
    return left.join(right.hint("merge"), on, how)


def deletions(word: Column) -> Column:
    """The word and what is left of it without any one letter."""
    left = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.array_distinct(F.concat(F.array(word), left))


def _close(a: Column, b: Column) -> Column:
    """One letter more, less or other, or two letters swapped."""
    letters = lambda c: F.array_sort(F.split(c, ""))
    return (F.levenshtein(a, b) <= 1) | (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 2) & (letters(a) == letters(b))


def _better(values: DataFrame, block: list[str], word: str, count: str, times: int, least_length: int) -> DataFrame:
    """(block, word, better): for words that have a close neighbour in their block which is at least ``times`` as frequent.

    Every word is compared with all words of its variants and goes to the most
    frequent close one; where that one goes to another itself, the word goes with
    it.  Ties go to the smaller word.
    """
    rank = lambda n, w: F.struct((-F.col(n)).alias("n"), F.col(w).alias("w"))
    known = values.where(F.length(word) >= least_length).select(*block, F.col(word).alias("word"), F.col(count).alias("own"))
    variants = known.select(*block, "word", "own", F.explode(deletions(F.col("word"))).alias("variant"))
    others = variants.select(*block, "variant", F.col("word").alias("other"), F.col("own").alias("times"))
    near = _met(variants, others, [*block, "variant"]).where((rank("times", "other") < rank("own", "word")) & (F.col("times") >= F.col("own") * times) & _close(F.col("other"), F.col("word")))
    to = staged(near.groupBy(*block, "word").agg(F.min(rank("times", "other"))["w"].alias("better")), "address-better")
    while True:
        onwards, before = to.select(*block, F.col("word").alias("better"), F.col("better").alias("further")), to
        to = staged(_met(to, onwards, [*block, "better"], "left").select(*block, "word", F.coalesce("further", "better").alias("better"), F.col("further").isNotNull().alias("moved")), "address-better")
        unstaged(before)
        if to.where("moved").limit(1).count() == 0:
            return to.select(*block, F.col("word").alias(word), "better")


def _respelled(words: DataFrame, times: int = 4) -> DataFrame:
    """(word, good): each word with its good spelling, by counts over all addresses."""
    counts = staged(words.groupBy("word").agg(F.count("*").alias("n")), "address-words")
    better = _better(counts, [], "word", "n", times, 4)
    return _met(counts, better, "word", "left").select("word", F.coalesce("better", "word").alias("good"))


def _joined_neighbours(placed: DataFrame) -> DataFrame:
    """(locality, number, street, kind, nearby): for buildings that a more frequent one of a neighbouring locality stands for.

    Both are given with the same postcode.  Chains are followed to their end.
    """
    key = ["number", "street", "kind"]
    size = placed.groupBy("locality", *key).agg(F.count("*").alias("n"))
    at = _met(placed.where("postcode is not null").select("postcode", "locality", *key).distinct(), size, ["locality", *key])
    at = staged(at, "address-at")  # one row for each postcode and spelling of a building's locality, which are few
    rank = lambda n, l: F.struct((-F.col(n)).alias("n"), F.col(l).alias("l"))  # noqa: E731, E741
    best = at.groupBy("postcode", *key).agg(F.min(rank("n", "locality"))["l"].alias("nearby"))
    to = _met(at, best, ["postcode", *key]).where("nearby <> locality")
    to = _met(to, size.select(F.col("locality").alias("nearby"), *key, F.col("n").alias("m")), ["nearby", *key])
    to = staged(to.groupBy("locality", *key).agg(F.min(rank("m", "nearby"))["l"].alias("nearby")), "address-nearby")
    while True:
        onwards = to.select(F.col("locality").alias("nearby"), *key, F.col("nearby").alias("further"))
        new = staged(_met(to, onwards, ["nearby", *key], "left").select("locality", *key, F.coalesce("further", "nearby").alias("nearby"), F.col("further").isNotNull().alias("moved")), "address-nearby")
        unstaged(to)
        if new.where("moved").limit(1).count() == 0:
            return new.drop("moved")
        to = new


def buildings(df: DataFrame, id_col: str = "sample_id", address: str = "address_1", units: bool = False) -> DataFrame:
    """(id, locality, number, street, kind): the building of every address that has a number, a street and a locality.

    units: a number with another flat, room or the like is another place (a hard
    veto); its ``number`` then ends in ``/unit``.  Without it, units make no difference.

    Null, empty and filler values and addresses without a number, street or
    locality have no row.  kind is empty where the type is not known, also where
    a street's name has several types in the block: such an address is at a
    building of its own, with those written without a type like it.  Repeated
    rows get a row each; everything is worked out once for each distinct text.
    """
    rows = df.where(F.length(address) > 0).select(F.col(id_col).alias("row_id"), F.sha2(F.col(address), 256).alias("address_key"), F.col(address).alias("address"))
    base = parsed(rows.select("address_key", "address").dropDuplicates(["address_key"]), "address_key", "address")
    number = F.when(F.col("unit") != "", F.concat_ws("/", "number", "unit")).otherwise(F.col("number")) if units else F.col("number")
    base = staged(base.withColumn("number", number).drop("unit"), "addresses")
    rest = base.select("rec_id", F.posexplode(F.split("rest", " ")).alias("pos", "word")).where("word <> ''")
    streets = base.where("street is not null").select(F.col("street").alias("word"))
    spelling = staged(_respelled(rest.select("word").unionByName(streets)), "address-good")

    # roles of words: how often each is a street's name, how often another word of a typed address
    typed = base.where("street is not null").select("rec_id")
    as_street = _met(streets, spelling, "word").groupBy("good").agg(F.count("*").alias("as_street"))
    good_rest = staged(_met(rest, spelling, "word").select("rec_id", "pos", "good"), "address-rest")
    as_town = _met(good_rest, typed, "rec_id", "left_semi").groupBy("good").agg(F.count("*").alias("as_town"))
    role = _met(as_street, as_town, "good", "full").select("good", (F.coalesce("as_street", F.lit(0)) > F.coalesce("as_town", F.lit(0))).alias("is_street"), (F.col("as_town") >= 3).alias("is_town"))

    # words beside the street make the town; in an address without a type the street is among them
    worded = _met(good_rest, role, "good", "left")
    in_street = F.coalesce("is_street", F.lit(False))
    sides = worded.groupBy("rec_id").agg(
        F.array_sort(F.collect_list(F.when(~in_street, F.struct("pos", "good")))).alias("town"),  # the words of one address
        F.array_sort(F.collect_list(F.when(F.col("is_town") & ~in_street, F.struct("pos", "good")))).alias("known_town"),
        F.min(F.when(in_street, F.struct("pos", "good"))).alias("loose"),
        F.array_sort(F.collect_list(F.struct("pos", "good"))).alias("all"),
    )
    words_of = lambda c: F.array_join(F.transform(c, lambda x: x["good"]), " ")
    named = _met(base.drop("rest"), spelling.select(F.col("word").alias("street"), F.col("good").alias("good_street")), "street", "left")
    named = _met(named, sides, "rec_id", "left")
    named = named.select(
        "rec_id", "number", "postcode",
        F.coalesce("good_street", F.col("loose.good")).alias("street"),
        F.coalesce("kind", F.lit("")).alias("kind"),
        F.when(F.size("known_town") > 0, words_of("known_town")).when(F.col("good_street").isNotNull(), words_of("all")).otherwise(words_of("town")).alias("town"),
    ).where("street is not null")
    named = staged(named.withColumn("town", F.when(F.col("town") != "", F.col("town"))), "addresses-named")

    # the town that most addresses give with a postcode; ties go to the smaller name
    pairs = named.where("postcode is not null and town is not null").groupBy("postcode", "town").count()
    town_of = pairs.groupBy("postcode").agg(F.min(F.struct((-F.col("count")).alias("n"), "town"))["town"].alias("its_town"))
    towns = named.where("town is not null").groupBy("town").agg(F.count("*").alias("town_rows"))
    placed = _met(_met(named, town_of, "postcode", "left"), towns, "town", "left")
    rare = F.col("its_town").isNotNull() & (F.coalesce("town_rows", F.lit(0)) < 3)
    locality = F.coalesce(F.when(rare, F.col("its_town")), F.col("town"), F.col("its_town"), F.concat(F.lit("postcode "), F.col("postcode")))
    placed = staged(placed.withColumn("locality", locality).where("locality is not null").select("rec_id", "locality", "postcode", "number", "street", "kind"), "addresses-placed")

    # inside blocks: spellings that the corpus could not decide
    block = ["locality", "number"]
    values = staged(placed.groupBy(*block, "street", "kind").agg(F.count("*").alias("n")), "address-values")
    merged = _better(values, [*block, "kind"], "street", "n", 1, 4)
    values = _met(values, merged, [*block, "kind", "street"], "left").withColumn("known", F.coalesce("better", "street"))
    # an address without a type takes the only one of its street in the block
    only = values.where("kind <> ''").groupBy(*block, "known").agg(F.countDistinct("kind").alias("kinds"), F.min("kind").alias("only_kind"))
    values = _met(values, only, [*block, "known"], "left")
    chosen = F.when((F.col("kind") == "") & (F.col("kinds") == 1), F.col("only_kind")).otherwise(F.col("kind"))
    values = values.select(*block, "street", "kind", F.col("known"), chosen.alias("chosen"))
    out = _met(placed, values, [*block, "street", "kind"])
    out = staged(out.select(F.col("rec_id").alias("address_key"), "locality", "postcode", "number", F.col("known").alias("street"), F.col("chosen").alias("kind")), "addresses-known")
    out = _met(out, _joined_neighbours(out), ["locality", "number", "street", "kind"], "left").withColumn("locality", F.coalesce("nearby", "locality"))
    return _met(rows.select("row_id", "address_key"), out, "address_key").select(F.col("row_id").alias(id_col), "locality", "number", "street", "kind")


def same_building(df: DataFrame, id_col: str = "sample_id", address: str = "address_1") -> DataFrame:
    """(<id>_a, <id>_b) with the smaller first: each pair of rows at the same building."""
    b = staged(buildings(df, id_col, address), "buildings")
    key = ["locality", "number", "street", "kind"]
    left, right = b.withColumnRenamed(id_col, "a"), b.withColumnRenamed(id_col, "b")
    return _met(left, right, key).where("a < b").select(F.col("a").alias(f"{id_col}_a"), F.col("b").alias(f"{id_col}_b"))


def building_classes(df: DataFrame, id_col: str = "sample_id", address: str = "address_1") -> DataFrame:
    """(id, building, n): each row with the smallest identifier at its building and the number of rows there."""
    b = staged(buildings(df, id_col, address), "buildings")
    key = ["locality", "number", "street", "kind"]
    counted = b.groupBy(*key).agg(F.min(id_col).alias("building"), F.count("*").alias("n"))
    return _met(b, counted, key).select(id_col, "building", "n")
