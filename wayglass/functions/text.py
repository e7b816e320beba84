"""Names, house numbers and coordinates as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One spelling of each common abbreviation in street names.
SHORT = {
    "street": "st", "saint": "st", "avenue": "ave", "av": "ave", "road": "rd", "drive": "dr", "boulevard": "blvd", "lane": "ln", "court": "ct", "place": "pl", "parkway": "pkwy", "pky": "pkwy", "highway": "hwy",
    "freeway": "fwy", "expressway": "expy", "circle": "cir", "terrace": "ter", "trail": "trl", "square": "sq", "cove": "cv", "crossing": "xing", "point": "pt", "mount": "mt", "fort": "ft", "heights": "hts",
    "junction": "jct", "loop": "lp", "plaza": "plz", "alley": "aly", "bypass": "byp", "creek": "crk", "estates": "ests", "grove": "grv", "harbor": "hbr", "hollow": "holw", "meadow": "mdw", "meadows": "mdws",
    "ridge": "rdg", "springs": "spgs", "spring": "spg", "turnpike": "tpke", "trace": "trce", "valley": "vly", "view": "vw", "vista": "vis", "north": "n", "south": "s", "east": "e", "west": "w",
    "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw",
}
#: What the search knows besides.
SEARCH_SHORT = SHORT | {"center": "ctr", "centre": "ctr", "international": "intl", "university": "univ"}
DIRECTIONS = ("n", "s", "e", "w", "ne", "nw", "se", "sw")
STREET_TYPES = (
    "st", "ave", "rd", "dr", "blvd", "ln", "ct", "pl", "pkwy", "hwy", "fwy", "expy", "cir", "ter", "trl", "sq", "cv", "xing", "pt", "lp", "plz", "aly", "byp", "way", "run", "row", "pass", "path", "pike", "walk",
)


def folded_letters() -> tuple[str, str]:
    """Letters of the Latin, Greek and Cyrillic blocks with marks, and what they fold to: by their compatibility decomposition without the marks."""
    pairs = []
    for code in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code) and plain.isalpha():
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = folded_letters()


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def words(text: Column) -> Column:
    """Lower case, no accents or apostrophes, & as and, cut at all that isn't a letter or digit."""
    t = F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"\p{M}+", "")
    t = F.regexp_replace(F.regexp_replace(t, "['’`]", ""), "&", " and ")
    return F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def canonical(word: Column, table: dict[str, str] = SEARCH_SHORT) -> Column:
    return F.coalesce(F.element_at(_map(table), word), word)


def street_key(name: Column) -> Column:
    """A street's matching key. An apostrophe parts words here, unlike in words()."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(name), r"[^\w\s]", " "), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: canonical(w, SHORT)), " ")


def loose_keys(key: Column) -> Column:
    """struct(bare, stem): the key without directions at its ends, and without the street type too."""
    way = "(?:" + "|".join(DIRECTIONS) + ")"
    bare = F.regexp_replace(F.regexp_replace(key, f"^(?:{way} )+(?=[^ ])", ""), f"(?<=[^ ])(?: {way})+$", "")
    stem = F.regexp_replace(bare, "(?<=[^ ]) (?:" + "|".join(STREET_TYPES) + ")$", "")
    return F.struct(bare.alias("bare"), stem.alias("stem"))


def tidy(text: Column, shouting: bool = False) -> Column:
    """Trimmed free text, null if nothing is left; with shouting, capitals become title case."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, "[​-‍⁠﻿]", ""), r"\s+", " "))
    t = F.nullif(t, F.lit(""))
    return F.when((F.upper(t) == t) & (F.lower(t) != t) & (F.length(t) > 3), F.initcap(F.lower(t))).otherwise(t) if shouting else t


def plausible_street(name: Column) -> Column:
    parts = F.split(F.trim(name), r"\s+")
    return name.rlike("[A-Za-z]") & ~name.contains(",") & ~((F.size(parts) > 1) & F.get(parts, F.lit(0)).rlike("^[0-9]+$"))


def alternatives(names: Column, main: Column) -> Column:
    """Other names joined by a middle dot, without those already there."""
    return F.aggregate(names, F.lit(""), lambda acc, x: F.when(x.isNull() | (x == "") | (F.lower(x) == F.lower(main)) | F.contains(F.lower(acc), F.lower(x)), acc).when(acc == "", x).otherwise(F.concat(acc, F.lit(" · "), x)))


def house_lead(number: Column) -> Column:
    """The number that a house number starts with, 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(number, "^[0-9]{1,9}", 0), F.lit("")).cast("long"), F.lit(0))


def house_numbers(text: Column) -> Column:
    """20;22 names two houses."""
    return F.filter(F.transform(F.split(text, "[;,]"), lambda p: F.trim(p)), lambda p: p != "")


def coordinates(text: Column, bbox: tuple[float, float, float, float] | None = None) -> Column:
    """struct(lon, lat) of "lat, lon", or of the other order where only that is on Earth, or only that is in bbox."""
    pattern = r"^(-?[0-9]{1,3}(?:[.][0-9]+)?)°?\s*[,;\s]\s*(-?[0-9]{1,3}(?:[.][0-9]+)?)°?$"
    a, b = (F.nullif(F.regexp_extract(F.trim(text), pattern, k), F.lit("")).try_cast("double") for k in (1, 2))
    point = lambda lon, lat: F.when((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.struct(lon.alias("lon"), lat.alias("lat")))
    first, second = point(b, a), point(a, b)
    if bbox is None:
        return F.coalesce(first, second)
    inside = lambda lon, lat: lon.between(bbox[0], bbox[2]) & lat.between(bbox[1], bbox[3])
    return F.when(second.isNotNull() & ~inside(b, a) & inside(a, b), second).otherwise(F.coalesce(first, second))


def distance_text(m: Column) -> Column:
    """Miles and feet as signs and screens have them."""
    feet, miles = m * 3.28084, m / 1609.344
    return F.when(miles < 0.1, F.concat((F.floor(feet / 50 + 0.5) * 50).cast("int").cast("string"), F.lit(" ft"))).when(miles < 10, F.concat(F.format_string("%.1f", F.floor(miles * 10 + 0.5) / 10), F.lit(" mi"))).otherwise(F.concat(F.floor(miles + 0.5).cast("string"), F.lit(" mi")))


def duration_text(seconds: Column) -> Column:
    minutes = F.greatest(F.floor(seconds / 60 + 0.5), F.lit(1)).cast("int")
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(F.concat((F.floor(minutes / 60)).cast("string"), F.lit(" h "), (minutes % 60).cast("string"), F.lit(" min")))


def percent_text(share: Column) -> Column:
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))
