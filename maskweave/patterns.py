"""The library of detection patterns and its translation for the JVM."""

from __future__ import annotations

import re

# fmt: off
# Type -> RE2 pattern. The order counts: it is the order of hits and breaks ties.
PATTERNS: dict[str, str] = {
    "EMAIL": r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b",
    "PHONE": r"\+?\b(?:\d{1,4}[- \s]?)?\(?\d{2,4}\)?[- \s]?\d{3,4}(?:[- \s]?\d{3,9})?\b",
    "URL": r"\bhttps?://[a-zA-Z0-9.-]+(?:/[^\s<>\"']*)?\b",
    "IP_ADDRESS": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    "IPV4_ADDRESS": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    "IPV6_ADDRESS": r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b|\b(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}\b",
    "MAC_ADDRESS": r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",
    "CREDIT_CARD": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{1,7}\b|\b\d{4}[-\s]?\d{6}[-\s]?\d{5}\b",
    "CURRENCY_AMOUNT": r"\b(?:USD|EUR|GBP|JPY|CNY|INR|CAD|AUD|CHF|SEK|NOK|DKK|ZAR)\s+\d{1,3}(?:[,\s]\d{3})*(?:\.\d{2})?\b|\b(?:USD|EUR|GBP|JPY|CNY|INR|CAD|AUD|CHF|SEK|NOK|DKK|ZAR)?\s?[\$€£¥₹₩₽]\s?\d{1,3}(?:[,\s]\d{3})*(?:\.\d{2})?\b|\b\d{1,3}(?:[,\s]\d{3})*(?:\.\d{2})?\s?(?:USD|EUR|GBP|JPY|CNY|INR|CAD)\b",
    "CRYPTO_BTC": r"\b(?:[13][a-km-zA-HJ-NP-Z1-9]{25,34}|bc1[a-zA-HJ-NP-Z0-9]{39,59})\b",
    "CRYPTO_ETH": r"\b0x[a-fA-F0-9]{40}\b",
    "IBAN": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "BIC_SWIFT": r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?\b",
    "VIN": r"\b[A-HJ-NPR-Z0-9]{17}\b",
    "DATE_ISO": r"\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})?)?\b",
    "SSN_US": r"\b\d{3}-\d{2}-\d{4}\b",
    "EIN_US": r"\b\d{2}-\d{7}\b",
    "US_PASSPORT": r"\b[A-Z][0-9]{8}\b|\b[0-9]{9}\b",
    "DRIVERS_LICENSE_US": r"\b[A-Z]{1,2}\d{6,8}\b|\b\d{8,9}\b|\b[A-Z]\d{7,8}\b",
    "MEDICAL_NPI_US": r"\b[0-9]{10}\b",
    "MEDICAL_LICENSE_US": r"\b[A-Z]{1,2}\d{6,9}\b",
    "SIN_CA": r"\b\d{3}-\d{3}-\d{3}\b",
    "CA_PASSPORT": r"\b[A-Z]{2}\d{6}\b",
    "DRIVERS_LICENSE_CA": r"\b[A-Z]\d{4,5}-\d{5,6}-\d{5}\b|\b[A-Z0-9]{5,15}\b",
    "NINO_GB": r"\b[A-CEGHJ-PR-TW-Z]{1}[A-CEGHJ-NPR-TW-Z]{1}\d{6}[A-DFM]?\b",
    "GB_PASSPORT": r"\b[0-9]{9}\b",
    "DRIVERS_LICENSE_GB": r"\b[A-Z9]{5}\d{6}[A-Z9]{2}\d[A-Z]{2}\b",
    "VAT_GB": r"\bGB\d{9}\b|\bGB\d{12}\b|\bGBGD\d{3}\b|\bGBHA\d{3}\b",
    "COMPANIES_HOUSE_GB": r"\b(?:SC|NI|OC|SO)?\d{6,8}\b",
    "INSEE_FR": r"\b[12]\d{12,14}\b",
    "VAT_FR": r"\bFR[A-HJ-NP-Z0-9]{2}\d{9}\b",
    "DRIVERS_LICENSE_FR": r"\b[A-Z0-9]{12}\b",
    "PASSPORT_FR": r"\b\d{2}[A-Z]{2}\d{5}\b",
    "DNI_ES": r"\b\d{8}[A-HJ-NP-TV-Z]\b",
    "NIE_ES": r"\b[XYZ]\d{7}[A-HJ-NP-TV-Z]\b",
    "CIF_ES": r"\b[A-HJ-NP-S]\d{7}[A-J0-9]\b",
    "VAT_ES": r"\bES[A-Z0-9]\d{7}[A-Z0-9]\b",
    "DRIVERS_LICENSE_ES": r"\b[A-Z0-9]{9,10}\b",
    "CODICE_FISCALE_IT": r"\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b",
    "VAT_IT": r"\bIT\d{11}\b",
    "DRIVERS_LICENSE_IT": r"\b[A-Z0-9]{10}\b",
    "AADHAAR_IN": r"\b\d{4}\s?\d{4}\s?\d{4}\b",
    "PAN_IN": r"\b[A-Z]{5}\d{4}[A-Z]\b",
    "GSTIN_IN": r"\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[A-Z0-9]{2}\b",
    "DRIVERS_LICENSE_IN": r"\b[A-Z]{2}\d{2}\s?\d{11}\b|\b[A-Z]{2}-\d{13}\b",
    "RESIDENT_ID_CN": r"\b\d{17}[\dXx]\b",
    "UNIFIED_SOCIAL_CREDIT_CODE_CN": r"\b[A-Z0-9]{18}\b",
    "PASSPORT_CN": r"\bE\d{8}\b|\bG\d{8}\b|\bS\d{8}\b",
    "STEUER_ID_DE": r"\b\d{11}\b",
    "VAT_DE": r"\bDE\d{9}\b",
    "PERSONALAUSWEIS_DE": r"\b[A-Z0-9]{9,10}\b",
    "DRIVERS_LICENSE_DE": r"\b[A-Z0-9]{11,12}\b",
    "MY_NUMBER_JP": r"\b\d{4}\s?\d{4}\s?\d{4}\b",
    "RESIDENT_CARD_JP": r"\b[A-Z]{2}\d{8}\b",
    "DRIVERS_LICENSE_JP": r"\b\d{12}\b",
    "RESIDENT_REGISTRATION_KR": r"\b\d{6}-\d{7}\b",
    "BUSINESS_REG_KR": r"\b\d{3}-\d{2}-\d{5}\b",
    "TFN_AU": r"\b\d{3}\s?\d{3}\s?\d{3}\b",
    "ABN_AU": r"\b\d{2}\s?\d{3}\s?\d{3}\s?\d{3}\b",
    "DRIVERS_LICENSE_AU": r"\b[A-Z0-9]{8,10}\b",
    "IRD_NZ": r"\b\d{2,3}-\d{3,4}-\d{3}\b",
    "CPF_BR": r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b",
    "CNPJ_BR": r"\b\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}\b",
    "RG_BR": r"\b\d{2}\.?\d{3}\.?\d{3}-?[0-9X]\b",
    "CURP_MX": r"\b[A-Z]{4}\d{6}[HM][A-Z]{5}[0-9A-Z]\d\b",
    "RFC_MX": r"\b[A-Z]{3,4}\d{6}[A-Z0-9]{3}\b",
    "DNI_AR": r"\b\d{8}\b",
    "ID_ZA": r"\b\d{13}\b",
    "TAX_ZA": r"\b\d{10}\b",
    "NRIC_SG": r"\b[SGT]\d{7}[A-Z]\b",
    "HKID_HK": r"\b[A-Z]{1,2}\d{6}[0-9A]\b",
    "NATIONAL_ID_TW": r"\b[A-Z]\d{9}\b",
    "BSN_NL": r"\b\d{9}\b",
    "VAT_NL": r"\bNL\d{9}B\d{2}\b",
    "NISS_BE": r"\b\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2}\b|\b\d{11}\b",
    "AHV_CH": r"\b756\.\d{4}\.\d{4}\.\d{2}\b|\b756\d{10}\b",
    "VAT_CH": r"\bCHE\d{9}(?:MWST|TVA|IVA)?\b",
    "SVNR_AT": r"\b\d{10}\b",
    "PERSONAL_ID_SE": r"\b\d{6,8}-\d{4}\b",
    "NATIONAL_ID_NO": r"\b\d{11}\b",
    "CPR_DK": r"\b\d{6}-\d{4}\b",
    "HETU_FI": r"\b\d{6}[+\-A]\d{3}[0-9A-Z]\b",
    "PESEL_PL": r"\b\d{11}\b",
    "PPS_IE": r"\b\d{7}[A-W]\b",
    "NIF_PT": r"\b\d{9}\b",
    "AMKA_GR": r"\b\d{11}\b",
    "ID_IL": r"\b\d{9}\b",
    "NATIONAL_ID_TR": r"\b\d{11}\b",
    "PASSPORT_RU": r"\b\d{2}\s?\d{2}\s?\d{6}\b",
    "NATIONAL_ID_TH": r"\b\d{13}\b",
    "NRIC_MY": r"\b\d{6}-\d{2}-\d{4}\b",
    "NIK_ID": r"\b\d{16}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
}
# fmt: on

# Suffixes of country-specific types, and types without a suffix that belong to one country.
COUNTRIES = frozenset(
    ["US", "CA", "GB", "FR", "ES", "IT", "IN", "CN", "DE", "JP", "KR", "AU", "NZ", "BR", "MX", "AR", "ZA", "SG", "HK", "TW", "NL", "BE", "CH", "AT", "SE", "NO", "DK", "FI", "PL", "IE", "PT", "GR", "IL", "TR", "RU", "TH", "MY", "ID"]
)
COUNTRY_OF = {"SSN": "US"}

# Which type wins when one text has several; a type that is not listed has 0.
PRIORITY: dict[str, int] = {
    "CREDIT_CARD": 15, "IBAN": 14, "CRYPTO_BTC": 13, "CRYPTO_ETH": 13, "EMAIL": 12,
    "SSN": 11, "SSN_US": 11, "SIN_CA": 11, "NINO_GB": 11, "INSEE_FR": 11, "AADHAAR_IN": 11, "RESIDENT_ID_CN": 11,
    "EIN_US": 10, "VAT_GB": 10, "VAT_FR": 10, "VAT_ES": 10, "VAT_IT": 10, "VAT_DE": 10, "PAN_IN": 10, "GSTIN_IN": 10, "UNIFIED_SOCIAL_CREDIT_CODE_CN": 10,
    "IPV4_ADDRESS": 9, "IP_ADDRESS": 9, "IPV6_ADDRESS": 9, "MAC_ADDRESS": 8, "VIN": 8, "MEDICAL_NPI_US": 8, "PASSPORT": 7, "US_PASSPORT": 7, "GB_PASSPORT": 7,
    "DRIVERS_LICENSE_US": 6, "DRIVERS_LICENSE_GB": 6, "DRIVERS_LICENSE_FR": 6, "DRIVERS_LICENSE_CA": 6, "DATE_ISO": 5, "CURRENCY_AMOUNT": 5, "BIC_SWIFT": 5,
    "PHONE": 4, "URL": 4, "INDIRECT": 4, "PERSON": 3, "CUSTOM": 3, "ORGANIZATION": 2, "LOCATION": 1, "ADDRESS": 1,
}
LIKE = "_LIKE"

#: Types whose pattern has a word boundary beside something that need not be a word character.
_TWO_SIDED = frozenset(["EMAIL", "PHONE", "URL", "IPV6_ADDRESS", "CURRENCY_AMOUNT"])
_W = "[0-9A-Za-z_]"
_BOUNDARY = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
_SPACE = r"\t\n\f\r "


def country_of(type_: str) -> str | None:
    """The country a type belongs to, by its alias or last part; None if it is universal."""
    upper = type_.upper()
    last = upper.split("_")[-1]
    return COUNTRY_OF.get(upper) or (last if last in COUNTRIES else None)


def select(countries: list[str] | None = None, patterns: dict[str, str] | None = None) -> dict[str, str]:
    """Universal patterns and those of the wanted countries; all if none is named; ValueError for unknown codes."""
    library = PATTERNS if patterns is None else patterns
    wanted = {c.strip().upper() for c in countries or [] if c and c.strip()}
    if unknown := wanted - COUNTRIES:
        raise ValueError(f"unknown country codes: {', '.join(sorted(unknown))}")
    return {t: p for t, p in library.items() if not wanted or country_of(t) is None or country_of(t) in wanted}


def parent(type_: str) -> str:
    """The type of which this is the look-alike, else the type itself."""
    upper = type_.upper()
    return upper[: -len(LIKE)] if upper.endswith(LIKE) and upper != LIKE else upper


def priority(type_: str) -> int:
    """Rank of a type; a look-alike stands just below its parent."""
    upper = type_.upper()
    return PRIORITY.get(parent(upper), 0) - 1 if upper.endswith(LIKE) else PRIORITY.get(upper, 0)


def java(pattern: str, type_: str = "") -> str:
    r"""The pattern for the JVM with RE2's meaning of \b (ASCII) and \s (no vertical tab).

    Where a boundary lies beside a character that must be an ASCII word
    character, the half of the test that can fail is enough; that holds for the
    library's patterns but for those in ``_TWO_SIDED``.  Other patterns get the
    full test.
    """
    half = type_ in PATTERNS and PATTERNS[type_] == pattern and type_ not in _TWO_SIDED
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b" and not in_class:
            opening = i == 0 or pattern[i - 1] in "|(" or pattern[i - 2 : i] == "?:"
            out.append((f"(?<!{_W})" if opening else f"(?!{_W})") if half else _BOUNDARY)
        elif two == r"\s":
            out.append(_SPACE if in_class else f"[{_SPACE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            in_class = two[0] == "[" or in_class and two[0] != "]"
            out.append(two[0])
            i += 1
            continue
        i += 2
    return "".join(out)


#: One scan finds every word that a one-word pattern can match: a maximal run of ASCII word characters, all of them capitals or digits.
ONE_WORD = f"(?<!{_W})[A-Z0-9]{{5,}}(?!{_W})"
_ONE_WORD_PARTS = re.compile(r"(?:\\d|\[[A-Z0-9-]+\]|[A-Z0-9]|\{\d+(?:,\d+)?\}|\(\?:|\(|\)|\||\?)+")
_LENGTH_ONLY = re.compile(r"(\\d|\[A-Z0-9\])\{(\d+)(?:,(\d+))?\}")
# What a text must hold for a pattern to match, where that is quickly seen.
_NEEDS = {
    "EMAIL": "@", "URL": "http", "IP_ADDRESS": r"[0-9]\.[0-9]", "IPV4_ADDRESS": r"[0-9]\.[0-9]", "IPV6_ADDRESS": r"[0-9a-fA-F]:[0-9a-fA-F]{0,4}:", "MAC_ADDRESS": r"[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]",
    "CURRENCY_AMOUNT": r"[$€£¥₹₩₽]|USD|EUR|GBP|JPY|CNY|INR|CAD|AUD|CHF|SEK|NOK|DKK|ZAR", "CRYPTO_ETH": "0x", "CREDIT_CARD": r"[0-9]{4}[- \t\n\f\r]?[0-9]{4}",
}


def one_word(pattern: str) -> str | None:
    r"""The pattern of a whole word, if every match of the pattern is one.

    Then each alternative stands between two \b and holds capitals and digits
    only, so that a match can neither begin nor end inside a run of word
    characters.
    """
    inner = []
    depth = part = 0
    for i, c in enumerate(pattern + "|"):
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            one, part = pattern[part:i], i + 1
            if len(one) < 5 or not one.startswith(r"\b") or not one.endswith(r"\b") or r"\b" in one[2:-2] or not _ONE_WORD_PARTS.fullmatch(one[2:-2]):
                return None
            inner.append(one[2:-2])
    least = min(_least(x) for x in inner)
    return "|".join(inner) if least >= 5 else None


def _least(pattern: str) -> int:
    """A lower bound of the length of what a one-word pattern matches."""
    flat = re.sub(r"\((?:\?:)?[^()]*\)\?", "", pattern)
    total = 0
    for _, lo, maybe in re.findall(r"(\\d|\[[^\]]+\]|[A-Z0-9])(?:\{(\d+)(?:,\d+)?\})?(\?)?", flat):
        total += 0 if maybe else int(lo) if lo else 1
    return total


def lengths(pattern: str) -> tuple[bool, int, int] | None:
    """(digits only, least, most) if a one-word pattern asks for nothing but a length."""
    m = _LENGTH_ONLY.fullmatch(pattern)
    return (m[1] == r"\d", int(m[2]), int(m[3] or m[2])) if m else None


def needs(type_: str, pattern: str) -> str | None:
    """A quick pattern that every text with a match holds; None if there is none."""
    if PATTERNS.get(type_) != pattern:
        return None
    # patterns of the library that can't match without a hyphen
    if type_ not in _NEEDS and re.fullmatch(r"(?:\\b(?:\\d|\[[^\]]*\]|\{[^}]*\}|-)+\\b)", pattern) and "-" in re.sub(r"\[[^\]]*\]", "", pattern):
        return "[0-9]-[0-9]"
    return _NEEDS.get(type_)


def python(pattern: str) -> re.Pattern[str]:
    r"""The pattern for Python's re with the same meaning."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(_SPACE if in_class else f"[{_SPACE}]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            in_class = two[0] == "[" or in_class and two[0] != "]"
            out.append(two[0])
            i += 1
    return re.compile("".join(out), re.ASCII)
