"""Address parts, full addresses and searchable text of a place's tags; queries taken apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placespark.functions.category import tag
from placespark.functions.text import STREET_WORDS, normal_text

#: Tags of the address fields, and tags first and left out in searchable text.
FIELDS = ["housenumber", "street", "suburb", "district", "city", "postcode", "state", "country", "place", "unit", "floor"]
CITY_TAGS = ["addr:city", "addr:town", "addr:village", "addr:hamlet"]
CITIES = ["cairo", "giza", "alexandria", "zamalek", "maadi", "heliopolis", "nasr city", "mohandessin", "dokki", "agouza", "helwan", "new cairo", "6th of october", "sheikh zayed"]
FIRST_TAGS = ["name", "name:en", "name:ar", "name:fr", "alt_name", "old_name", "brand", "operator"]
SKIPPED_TAGS = "^(?:source|created_by|note|fixme|import|tiger|gnis|ref|osm|wikidata|wikipedia)"


def components(tags: Column) -> Column:
    """Struct of the address fields, trimmed, null where missing; the city may come from town, village or hamlet."""
    own = {f: F.nullif(F.trim(tag(tags, f"addr:{f}")), F.lit("")) for f in FIELDS}
    own["city"] = F.coalesce(*[F.nullif(F.trim(tag(tags, t)), F.lit("")) for t in CITY_TAGS])
    return F.struct(*[c.alias(f) for f, c in own.items()])


def has_address(tags: Column) -> Column:
    return F.coalesce(*[tag(tags, f"addr:{f}") for f in FIELDS]).isNotNull()


def full_address(a: Column) -> Column:
    """Unit, floor, number and street (or place), then the localities, comma-separated; '' without any."""
    line = F.when(a["street"].isNotNull(), F.concat_ws(" ", a["housenumber"], a["street"])).otherwise(F.coalesce(a["housenumber"], a["place"]))
    named = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(label), c))
    return F.concat_ws(", ", named("Unit ", a["unit"]), named("Floor ", a["floor"]), line, *[a[f] for f in ("suburb", "district", "city", "postcode", "state", "country")])


def searchable_text(tags: Column, first: list[str] = FIRST_TAGS, skipped: str = SKIPPED_TAGS) -> Column:
    """Values of the first tags, then of all others by their keys' order but skipped ones."""
    chosen = F.filter(F.array(*map(F.lit, first)), lambda k: F.try_element_at(tags, k).isNotNull())
    rest = F.filter(F.array_sort(F.map_keys(tags)), lambda k: ~k.isin(first) & ~k.rlike(skipped))
    return F.array_join(F.filter(F.array_distinct(F.transform(F.concat(chosen, rest), lambda k: F.trim(F.try_element_at(tags, k)))), lambda v: v != ""), " ")


def parsed_query(q: Column, cities: list[str] = CITIES) -> Column:
    """A query's struct: raw, housenumber, street, city, suburb, state, postcode, country.

    Comma parts one by one: postcodes (4 to 6 digits) out first; the street is the first part that begins with a house
    number, else that ends in a known city after a street word, else that holds a street word, else the first part (one
    part that is a city is a city). The others become country (2 or 3 capitals), city, suburb and state in turn.
    """
    raw = normal_text(q)
    parts = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda p: p != "")
    is_code = lambda p: p.rlike(r"^\d{4,6}$")
    rest = F.filter(parts, lambda p: ~is_code(p))
    known = F.array(*[F.lit(c) for c in sorted(cities, key=len, reverse=True)])
    numbered = lambda p: p.rlike(r"^\d[\w/-]*\s+.") & ~p.rlike(r"(?i)^\d+(?:st|nd|rd|th)\s")
    city_end = lambda p: F.get(F.filter(known, lambda c: F.endswith(F.lower(p), F.concat(F.lit(" "), c))), F.lit(0))
    worded = lambda p: p.rlike(f"(?i){STREET_WORDS}")

    def first_place(test) -> Column:
        return F.get(F.filter(F.transform(rest, lambda p, i: F.when(test(p), i)), lambda i: i.isNotNull()), F.lit(0))

    by_number, by_city, by_word = first_place(numbered), first_place(lambda p: city_end(p).isNotNull() & worded(p)), first_place(worded)
    lone_city = (F.size(rest) == 1) & by_number.isNull() & by_city.isNull() & by_word.isNull() & F.array_contains(known, F.lower(F.get(rest, F.lit(0))))
    place = F.coalesce(by_number, by_city, by_word, F.when(F.size(rest) > 0, F.lit(0)))
    part = F.get(rest, place)
    end = F.when(by_number.isNull() & by_city.isNotNull(), city_end(part))
    others = F.filter(rest, lambda p, i: i != place)
    is_country = lambda p: p.rlike("^[A-Z]{2,3}$")
    is_city = lambda p: F.array_contains(known, F.lower(p))
    local = F.filter(others, lambda p: ~is_country(p))
    own_city = F.coalesce(end, F.when(lone_city, part))
    named = F.get(F.filter(local, is_city), F.lit(0))
    first = F.get(local, F.lit(0))
    city = F.coalesce(own_city, F.when(is_city(first), first), F.when(named.isNotNull() & own_city.isNull() & (F.size(local) == 1), named), first)
    left = F.when(own_city.isNull(), F.slice(local, F.lit(2), F.greatest(F.size(local) - 1, F.lit(0)))).otherwise(local)
    left = F.filter(left, lambda p: ~is_city(p))
    street = F.when(by_number.isNotNull(), F.regexp_extract(part, r"^\d[\w/-]*\s+(.+)$", 1)).when(end.isNotNull(), F.trim(F.substring(part, F.lit(1), F.length(part) - F.length(end)))).when(~lone_city, part)
    return F.struct(
        raw.alias("raw"), F.when(by_number.isNotNull(), F.regexp_extract(part, r"^(\d[\w/-]*)", 1)).alias("housenumber"), street.alias("street"), city.alias("city"),
        F.get(left, F.lit(0)).alias("suburb"), F.get(left, F.lit(1)).alias("state"), F.get(F.filter(parts, is_code), F.lit(0)).alias("postcode"), F.get(F.filter(others, is_country), F.lit(0)).alias("country"),
    )
