"""Text forms of names, streets and queries as columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arabic letters that are written alike, street words and abbreviations of three languages.
AR_FROM, AR_TO = "إأآىة", "ااايه"
TATWEEL = "ـ"
AR_MARKS = "".join(map(chr, [*range(0x064B, 0x0653), 0x0640, 0x0670]))
APOSTROPHES = "'’ʼ"
AR_TOKENS = {"ش": "شارع", "ش.": "شارع", "شار": "شارع", "ط": "طريق", "م": "ميدان"}
EN_WORDS = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bvd": "boulevard", "ln": "lane",
    "dr": "drive", "pl": "place", "ct": "court", "sq": "square", "hwy": "highway", "cres": "crescent", "terr": "terrace", "pkwy": "parkway",
}
FR_WORDS = {
    "r": "rue", "av": "avenue", "bd": "boulevard", "blvd": "boulevard", "pl": "place", "ch": "chemin", "imp": "impasse", "all": "allée",
    "crs": "cours", "rte": "route", "pass": "passage",
}
STREET_PREFIXES = ["شارع", "ش", "طريق", "حارة", "حاره", "زقاق", "ميدان", "street", "st", "road", "rd", "avenue", "ave"]
STREET_WORDS = (
    r"\b(street|road|avenue|ave|blvd|boulevard|lane|drive|dr|place|pl|court|ct|way|alley|square|sq|highway|hwy|st|crescent|terrace|parkway"
    r"|rue|chemin|impasse|allée|cour|cours|passage|quai|route|voie|rond-point|carrefour)\b|شارع|طريق|ميدان|حارة|زقاق|كورنيش|حي|منطقة|ش\s"
)
ADDRESS_TOKENS = ["شارع", "طريق", "ميدان", "حارة", "زقاق", "كورنيش", "حي", "منطقة", "مدينة", "محافظة", "عمارة", "برج", "مبنى", "عمائر"]
ORDINALS = [
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth",
    "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth",
]
GENERIC_STREET_WORDS = ["street", "st", "road", "rd", "avenue", "ave", "شارع", "طريق", "rue"]


def _latin_folds() -> tuple[str, str]:
    """Letters that decompose to one plain letter and marks, and those letters."""
    out = [(chr(c), d[0]) for c in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)] if len(d := unicodedata.normalize("NFKD", chr(c))) > 1 and not unicodedata.combining(d[0]) and all(map(unicodedata.combining, d[1:]))]
    return "".join(a for a, _ in out), "".join(b for _, b in out)


FOLD_FROM, FOLD_TO = _latin_folds()


def fold_marks(s: Column) -> Column:
    """Letters without accents and other marks."""
    return F.regexp_replace(F.translate(s, FOLD_FROM, FOLD_TO), r"\p{M}+", "")


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def _expand(s: Column, words: dict[str, str]) -> Column:
    """Whole words, in any case, by their long forms; groups of the same long form are one replacement."""
    by_form: dict[str, list[str]] = {}
    for short, form in words.items():
        by_form.setdefault(form, []).append(short)
    for form, shorts in by_form.items():
        s = F.regexp_replace(s, rf"(?i)(?<![\p{{L}}\p{{N}}_])({'|'.join(sorted(shorts, key=len, reverse=True))})(?![\p{{L}}\p{{N}}_])", form)
    return s


def normal_text(s: Column, french: bool = True) -> Column:
    """The search form of a query or address: Arabic spellings unified, abbreviations spelled out, marks off, spaces single."""
    s = F.translate(F.regexp_replace(s, TATWEEL, ""), AR_FROM, AR_TO)
    tokens = F.transform(F.split(collapse(s), " "), lambda t: F.coalesce(*[F.when(t == k, v) for k, v in AR_TOKENS.items()], t))
    s = _expand(F.array_join(tokens, " "), EN_WORDS)
    s = _expand(s, FR_WORDS) if french else s
    return collapse(fold_marks(F.translate(s, APOSTROPHES, "")))


def street_form(s: Column) -> Column:
    """The join form of a street name: lower case, Arabic marks off and spellings unified, one leading street word off; null becomes ''."""
    s = collapse(F.translate(F.lower(F.coalesce(s, F.lit(""))), AR_FROM + AR_MARKS, AR_TO))
    return F.regexp_replace(s, f"^(?:{'|'.join(sorted(STREET_PREFIXES, key=len, reverse=True))}) (?=.)", "")


def suggestion_form(s: Column) -> Column:
    """The form that prefixes are taken of: the search form in lower case, punctuation as spaces."""
    return collapse(F.regexp_replace(F.lower(normal_text(s)), r"[^\p{L}\p{N}\s]+", " "))


def tokens(s: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(s, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def with_ordinals_swapped(s: Column) -> Column:
    """The other spelling of explicit ordinals up to the twentieth (5th, fifth); null if there are none."""
    suffix = lambda n: {1: "st", 2: "nd", 3: "rd"}.get(n, "th")
    swaps = {f"{n}{suffix(n)}": w for n, w in enumerate(ORDINALS, 1)}
    pairs = [F.lit(x) for k, v in swaps.items() for x in (k, v, v, k)]
    table = F.create_map(*pairs)
    swapped = F.array_join(F.transform(F.split(collapse(s), " "), lambda t: F.coalesce(F.try_element_at(table, F.lower(t)), t)), " ")
    return F.when(swapped != collapse(s), swapped)


def looks_like_address(s: Column) -> Column:
    """Begins with a house number and words, has commas, or holds a street or address word."""
    s = F.trim(s)
    numbered = s.rlike(r"^\d[\w/-]*\s+\w") & ~s.rlike(r"(?i)^\d+(?:st|nd|rd|th)(?:\s|$)")
    return F.coalesce((s != "") & (numbered | F.contains(s, F.lit(",")) | s.rlike(f"(?i){STREET_WORDS}") | F.arrays_overlap(F.split(s, r"\s+"), F.array(*map(F.lit, ADDRESS_TOKENS)))), F.lit(False))


def house_number(s: Column) -> Column:
    """Its first run of digits as a number."""
    return F.nullif(F.regexp_extract(s, r"(\d+)", 1), F.lit("")).try_cast("bigint")


def whole_number(s: Column) -> Column:
    """A text that is a whole number, without commas and spaces."""
    return F.regexp_replace(s, "[, ]", "").try_cast("bigint")


def number_proximity(asked: Column, found: Column) -> Column:
    """1 / (1 + difference) of two house numbers that are whole numbers; else 0."""
    return F.coalesce(1.0 / (1.0 + F.abs(asked.try_cast("bigint") - found.try_cast("bigint"))), F.lit(0.0))


def street_in_address(street: Column, address: Column) -> Column:
    """Whether all of the street's words but generic ones stand in the address."""
    words = F.filter(F.split(street_form(street), " "), lambda t: (t != "") & ~t.isin(GENERIC_STREET_WORDS))
    return (F.size(words) > 0) & F.forall(words, lambda t: F.contains(street_form(address), t))


def prefixes(texts: Column, shortest: int = 2, longest: int = 6) -> Column:
    """Distinct prefixes of the texts and of each of their words that are long enough."""
    whole = F.concat(texts, F.filter(F.flatten(F.transform(texts, lambda t: F.split(t, " "))), lambda w: F.length(w) >= shortest))
    cut = F.transform(whole, lambda t: F.when(F.length(t) >= shortest, F.transform(F.sequence(F.lit(shortest), F.least(F.length(t), F.lit(longest))), lambda n: F.substring(t, F.lit(1), n))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.transform(F.flatten(cut), lambda p: F.rtrim(p)))


def edge_grams(s: Column, shortest: int = 2, longest: int = 15) -> Column:
    """Prefixes of every token."""
    return F.array_distinct(F.flatten(F.transform(F.filter(tokens(s), lambda t: F.length(t) >= shortest), lambda t: F.transform(F.sequence(F.lit(shortest), F.least(F.length(t), F.lit(longest))), lambda n: F.substring(t, F.lit(1), n)))))
