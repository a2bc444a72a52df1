"""SQL for DuckDB of the core's queries.

DuckDB's regular expressions are RE2, the dialect the patterns are written in,
so the library's texts go in as they stand.
"""

from __future__ import annotations

from maskweave import patterns as P
from maskweave.functions import checksums as C

#: What the patterns' boundaries and spaces mean needs no translation here; only quotes are doubled.
q = lambda s: "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], name: str) -> str:
    text = lambda v: q(v) if isinstance(v, str) else "NULL" if v is None else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(text(v) for v in r) + ')' for r in rows)}) AS {name}"


def digits(c: str) -> str:
    return f"regexp_replace({c}, '[^0-9]', '', 'g')"


def alnum(c: str) -> str:
    return f"regexp_replace(upper({c}), '[^\\pL\\pN]', '', 'g')"


def _ints(d: str, n: str | None = None) -> str:
    return f"list_transform(range(1, {n or f'length({d})'} + 1), lambda i: CAST(substr({d}, i, 1) AS INT))"


def luhn(c: str) -> str:
    d = digits(c)
    x = f"CAST(substr({d}, length({d}) - i + 1, 1) AS INT)"
    return f"(length({d}) > 0 AND list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {x} WHEN {x} > 4 THEN 2 * {x} - 9 ELSE 2 * {x} END)) % 10 = 0)"


def verhoeff(c: str) -> str:
    d = digits(c)
    table = "[" + ", ".join("[" + ", ".join(str(C._dihedral(a, b)) for b in range(10)) + "]" for a in range(10)) + "]"
    powers = "[" + ", ".join(str(r) for r in C._permutations()) + "]"
    step = f"{table}[a + 1][{powers}[(length({d}) - i) % 8 + 1][CAST(substr({d}, i, 1) AS INT) + 1] + 1]"
    return f"(length({d}) > 0 AND list_reduce(list_reverse(range(1, length({d}) + 1)), lambda a, i: {step}, 0) = 0)"


def _weighted(d: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"{w} * CAST(substr({d}, {i}, 1) AS INT)" for i, w in enumerate(weights, 1)) + ")"


def iban(c: str) -> str:
    a = alnum(c)
    lengths = "CASE substr(" + a + ", 1, 2) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.IBAN_LENGTHS.items()) + " ELSE -1 END"
    ch = f"substr(substr({a}, 5) || substr({a}, 1, 4), i, 1)"
    step = f"CASE WHEN {ch} BETWEEN '0' AND '9' THEN (s * 10 + ascii({ch}) - 48) % 97 ELSE (s * 100 + ascii({ch}) - 55) % 97 END"
    return f"(regexp_full_match({a}, '[A-Z]{{2}}[0-9]{{2}}[0-9A-Z]+') AND length({a}) = {lengths} AND list_reduce(range(1, length({a}) + 1), lambda s, i: CAST({step} AS BIGINT), 0::BIGINT) = 1)"


def vin(c: str) -> str:
    a = alnum(c)
    n = f"translate({a}, '{C.VIN_LETTERS}', '{C.VIN_DIGITS}')"
    r = f"({_weighted(n, C.VIN_WEIGHTS)} % 11)"
    return f"(CASE WHEN regexp_full_match({a}, '[A-HJ-NPR-Z0-9]{{17}}') THEN substr({a}, 9, 1) = CASE WHEN {r} = 10 THEN 'X' ELSE CAST({r} AS VARCHAR) END ELSE false END)"


def dni(c: str, plain: bool = False) -> str:
    a = c if plain else alnum(c)
    return f"(CASE WHEN regexp_full_match({a}, '[0-9]{{8}}[A-Z]') THEN substr({a}, 9, 1) = substr('{C.DNI_LETTERS}', CAST(CAST(substr({a}, 1, 8) AS INT) % 23 + 1 AS INT), 1) ELSE false END)"


def nie(c: str) -> str:
    a = alnum(c)
    inner = dni(f"(translate(substr({a}, 1, 1), 'XYZ', '012') || substr({a}, 2))", plain=True)
    return f"(CASE WHEN regexp_full_match({a}, '[XYZ][0-9]{{7}}[A-Z]') THEN {inner} ELSE false END)"


def cn(c: str) -> str:
    a = alnum(c)
    return f"(CASE WHEN regexp_full_match({a}, '[0-9]{{17}}[0-9X]') THEN substr({a}, 18, 1) = substr('{C.CN_CHECK}', CAST({_weighted(a, C.CN_WEIGHTS)} % 11 + 1 AS INT), 1) ELSE false END)"


def aadhaar(c: str) -> str:
    return f"(regexp_full_match({digits(c)}, '[2-9][0-9]{{11}}') AND {verhoeff(c)})"


def cpf(c: str) -> str:
    d = digits(c)
    one = lambda n: f"CAST((({_weighted(d, tuple(range(n + 1, 1, -1)))} * 10) % 11) % 10 AS VARCHAR) = substr({d}, {n + 1}, 1)"
    return f"(CASE WHEN length({d}) = 11 AND {d} <> repeat(substr({d}, 1, 1), 11) THEN {one(9)} AND {one(10)} ELSE false END)"


def codice(c: str) -> str:
    a = alnum(c)
    odd = lambda i: f"CASE WHEN substr({a}, {i}, 1) BETWEEN '0' AND '9' THEN {list(C.CF_ODD_DIGITS)}[ascii(substr({a}, {i}, 1)) - 47] ELSE {list(C.CF_ODD_LETTERS)}[ascii(substr({a}, {i}, 1)) - 64] END"
    even = lambda i: f"CASE WHEN substr({a}, {i}, 1) BETWEEN '0' AND '9' THEN ascii(substr({a}, {i}, 1)) - 48 ELSE ascii(substr({a}, {i}, 1)) - 65 END"
    total = " + ".join(odd(i) if i % 2 else even(i) for i in range(1, 16))
    return f"(CASE WHEN regexp_full_match({a}, '[A-Z0-9]{{15}}[A-Z]') THEN substr({a}, 16, 1) = chr(CAST(({total}) % 26 + 65 AS INT)) ELSE false END)"


def pesel(c: str) -> str:
    d = digits(c)
    return f"(CASE WHEN length({d}) = 11 THEN substr({d}, 11, 1) = CAST((10 - {_weighted(d, C.PESEL_WEIGHTS)} % 10) % 10 AS VARCHAR) ELSE false END)"


CHECKS = {
    "CREDIT_CARD": lambda c: f"(length({digits(c)}) BETWEEN 13 AND 19 AND {luhn(c)})",
    "IBAN": iban,
    "VIN": vin,
    "MEDICAL_NPI_US": lambda c: f"(length({digits(c)}) = 10 AND {luhn(f'(80840 || {digits(c)})')})",
    "SIN_CA": lambda c: f"(length({digits(c)}) = 9 AND {luhn(c)})",
    "DNI_ES": dni,
    "NIE_ES": nie,
    "RESIDENT_ID_CN": cn,
    "AADHAAR_IN": aadhaar,
    "CPF_BR": cpf,
    "CODICE_FISCALE_IT": codice,
    "PESEL_PL": pesel,
}


def hits(source: str = "documents", doc: str = "doc_id", text: str = "text", library: dict[str, str] | None = None, checked: bool = True) -> str:
    """SELECT of (doc_id, pattern_idx, match_idx, text, type)."""
    one = []
    for i, (t, rx) in enumerate((library or P.PATTERNS).items()):
        kind = q(t)
        if checked and t in CHECKS:
            kind = f"CASE WHEN {CHECKS[t]('v')} THEN {q(t)} ELSE {q(t + P.LIKE)} END"
        one.append(
            f"SELECT doc_id, {i} AS pattern_idx, k AS match_idx, v AS text, {kind} AS type FROM (SELECT doc_id, unnest(m) AS v, unnest(range(len(m))) AS k "
            f"FROM (SELECT {doc} AS doc_id, regexp_extract_all({text}, {q(rx)}) AS m FROM {source} WHERE {text} IS NOT NULL)) WHERE trim(v, E' \\t\\n\\r\\x0b\\x0c') <> ''"
        )
    return "\nUNION ALL\n".join(one)


def places(library: dict[str, str] | None = None) -> str:
    """SELECT of (doc_id, pattern_idx, match_idx, type, start_pos, end_pos): gaps and matches before a match make up its place."""
    one = []
    for i, (t, rx) in enumerate((library or P.PATTERNS).items()):
        lengths = lambda x, to: f"coalesce(list_sum(list_transform({x}[1:{to}], lambda y: length(y))), 0)"
        start = f"CAST({lengths('g', 'k + 1')} + {lengths('m', 'k')} AS INT)"
        one.append(
            f"SELECT doc_id, {i} AS pattern_idx, CAST(k AS INT) AS match_idx, {q(t)} AS type, {start} AS start_pos, CAST({start} + length(m[k + 1]) AS INT) AS end_pos FROM (SELECT doc_id, m, g, unnest(range(len(m))) AS k "
            f"FROM (SELECT doc_id, regexp_extract_all(text, {q(rx)}) AS m, string_split_regex(text, {q(rx)}) AS g FROM documents WHERE text IS NOT NULL))"
        )
    return "\nUNION ALL\n".join(one)


_PRIORITY = values([(k, v) for k, v in P.PRIORITY.items()], "pr(ptype, prio)")



def entities(place: tuple[str, ...] = ("pattern_idx", "match_idx"), seeds: str = "") -> str:
    """CTEs h, d, e0, longer, e of h0 (doc_id, text, type and the columns of the place in reading order).

    seeds: a CTE (original) whose values are base forms for every document.
    """
    order, first = ", ".join(place), ", ".join(f"first_{c}" for c in place)
    firsts = ", ".join(f"first_value({c}) OVER w AS first_{c}" for c in place)
    seeded = f" UNION SELECT doc_id, original FROM (SELECT DISTINCT doc_id FROM e0), {seeds}" if seeds else ""
    return f"""
h AS (SELECT h.*, coalesce(prio, 0) - CASE WHEN type LIKE '%\\_LIKE' ESCAPE '\\' THEN 1 ELSE 0 END AS p
      FROM (SELECT * FROM h0) h LEFT JOIN {_PRIORITY} ON ptype = CASE WHEN type LIKE '%\\_LIKE' ESCAPE '\\' THEN left(type, length(type) - 5) ELSE type END),
d AS (SELECT doc_id, text, {first}, type FROM (
      SELECT doc_id, text, type, {firsts}, row_number() OVER (PARTITION BY doc_id, text ORDER BY p DESC, {order}) AS r
      FROM h WINDOW w AS (PARTITION BY doc_id, text ORDER BY {order})) WHERE r = 1),
e0 AS MATERIALIZED (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {first}) AS INT) AS ord, text, type FROM d),
longer AS (SELECT a.doc_id, a.text, b.text AS base FROM e0 a JOIN (SELECT doc_id, text FROM e0{seeded}) b ON a.doc_id = b.doc_id AND a.text <> b.text AND contains(b.text, a.text)
           QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.text ORDER BY length(b.text) DESC, b.text) = 1),
e AS (SELECT e0.*, coalesce(base, e0.text) AS base_form FROM e0 LEFT JOIN longer USING (doc_id, text))
"""


ENTITIES = entities()

MAPPING = """
g AS (SELECT *, min(ord) OVER (PARTITION BY doc_id, base_form) AS group_ord, first_value(type) OVER (PARTITION BY doc_id, base_form ORDER BY ord) AS group_type FROM e),
n AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, group_type ORDER BY group_ord) AS n,
      sum(CASE WHEN text <> base_form THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, base_form ORDER BY ord) AS v FROM g),
m AS (SELECT doc_id, CASE WHEN text = base_form THEN group_ord ELSE ord END AS ord, text AS original, group_type || '_' || n || CASE WHEN text <> base_form THEN '.v_' || v ELSE '' END AS written, type, base_form FROM n)
"""


CORPUS = """
t AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id, ord) = 1),
f AS (SELECT base_form, doc_id AS fd, ord AS fo, type AS gtype FROM t QUALIFY row_number() OVER (PARTITION BY base_form ORDER BY doc_id, ord) = 1),
l AS (SELECT base_form, gtype || '_' || row_number() OVER (PARTITION BY gtype ORDER BY fd, fo) AS main FROM f),
c AS (SELECT text AS original, main || CASE WHEN text <> base_form THEN '.v_' || sum(CASE WHEN text <> base_form THEN 1 ELSE 0 END) OVER (PARTITION BY base_form ORDER BY doc_id, ord) ELSE '' END AS written, type, base_form FROM t JOIN l USING (base_form))
"""


def with_hits(tail: str, source: str = "documents", **kw: object) -> str:
    return f"WITH h0 AS ({hits(source, **kw)}), {tail}"


#: A word character of Python's rules.
WORDY = "'[\\pL\\pN_]'"


def chosen(parts: str, rounds: int = 5) -> str:
    """CTEs up to ``chosen`` (key, doc_id, s, e, entity) of the CTE e0 and parts (key, doc_id, body).

    Every place of an entity between words' ends; then, round by round, the
    places that no longer (or equal and further left) one overlaps are taken,
    and what they overlap is left out.
    """
    wordy = lambda c: f"regexp_full_match({c}, {WORDY})"
    out = f"""
cut AS (SELECT p.key, p.doc_id, p.body, x.text AS entity, string_split(p.body, x.text) AS g FROM ({parts}) p JOIN e0 x ON p.doc_id = x.doc_id AND x.text <> '' AND contains(p.body, x.text)),
occ AS (SELECT key, doc_id, body, entity, length(entity) AS n, CAST(list_sum(list_transform(g[1:k], lambda y: length(y))) + (k - 1) * length(entity) AS INT) AS s FROM (SELECT *, unnest(range(1, len(g))) AS k FROM cut)),
rem0 AS MATERIALIZED (SELECT key, doc_id, entity, n, s, s + n AS e FROM occ
  WHERE NOT ({wordy('entity[1]')} AND s > 0 AND {wordy('substr(body, s, 1)')}) AND NOT ({wordy('entity[-1]')} AND {wordy('substr(body, s + n + 1, 1)')}))"""
    over = "b.key = a.key AND b.s < a.e AND a.s < b.e"
    for i in range(1, rounds + 1):
        out += f""",
pick{i} AS MATERIALIZED (SELECT * FROM rem{i - 1} a WHERE NOT EXISTS (SELECT 1 FROM rem{i - 1} b WHERE {over} AND (b.n > a.n OR b.n = a.n AND b.s < a.s))),
rem{i} AS MATERIALIZED (SELECT * FROM rem{i - 1} a WHERE NOT EXISTS (SELECT 1 FROM pick{i} b WHERE {over}))"""
    return out + ",\nchosen AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT key, doc_id, s, e, entity FROM pick{i}" for i in range(1, rounds + 1)) + ")"


def masked(parts: str, mapping: str = "m", on: str = "c.doc_id = m.doc_id AND") -> str:
    """CTEs up to ``masked`` (key, doc_id, text): the chosen places written as the mapping says."""
    return (
        chosen(parts)
        + f""",
written AS (SELECT c.key, c.s, c.e, m.written FROM chosen c JOIN {mapping} m ON {on} m.original = c.entity),
gaps AS (SELECT w.*, substr(p.body, lag(w.e, 1, 0) OVER (PARTITION BY w.key ORDER BY w.s) + 1, w.s - lag(w.e, 1, 0) OVER (PARTITION BY w.key ORDER BY w.s)) AS gap FROM written w JOIN ({parts}) p USING (key)),
joined AS (SELECT key, string_agg(gap || written, '' ORDER BY s) AS front, max(e) AS last_e FROM gaps GROUP BY key),
masked AS MATERIALIZED (SELECT p.key, p.doc_id, CASE WHEN front IS NULL THEN p.body ELSE front || substr(p.body, last_e + 1) END AS text FROM ({parts}) p LEFT JOIN joined USING (key))"""
    )


DOCUMENT_PARTS = "SELECT doc_id AS key, doc_id, text AS body FROM documents"
LABELS = "'[A-Z_]+_[0-9]+(?:\\.v_[0-9]+)?'"


def mask_kind(t: str) -> str:
    return f"(CASE WHEN upper({t}) LIKE '%\\_LIKE' ESCAPE '\\' AND length({t}) > 5 THEN left(upper({t}), length({t}) - 5) ELSE upper({t}) END)"


def block(sha: str, i: int) -> str:
    """The i-th eight hex digits of a SHA-256 as a number."""
    digit = lambda k: f"(strpos('0123456789abcdef', substr({sha}, {8 * i + k + 1}, 1)) - 1)::BIGINT"
    return "(" + " + ".join(f"{digit(k)} * {16 ** (7 - k)}" for k in range(8)) + ")"
