"""Names, titles, links and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from eonmap.functions.dates import bind

# What marks a year range, a family of rulers and a ruler's title; names of countries
# that differ between the two atlases; tags that the viewer shows.
YEAR = r"c?\d+(?:BCE?|CE?|AD)?"
RANGE = rf"(?i){YEAR}\s*-\s*(?:{YEAR}|Present)"
SPAN = r"(?i)^\s*(?:c?\d|Before\s)"
FAMILY = r"(?i)\b(?:Dynasty|Caliphate|House|Family)\b"
TITLES = ("Pharaoh", "King", "Queen", "Emperor", "Empress", "Sultan", "Caliph", "Emir", "Khan", "Tsar", "Czar", "Shah", "Shogun", "Pope",
          "Duke", "Earl", "Count", "Baron", "Governor", "President", r"Prime\s+Minister", "Regent", "Lord", "Prince", "Princess",
          "Archon", "Doge", "Elector", "Viceroy", "Vizier")
ALIASES = {
    "america": "united states of america", "alaska": "united states of america", "aleutians": "united states of america",
    "hawaii": "united states of america", "britain": "united kingdom", "czech": "czechia", "slovak": "slovakia",
    "kazak": "kazakhstan", "kirgiz": "kyrgyzstan", "tadjik": "tajikistan", "turkmen": "turkmenistan", "uzbeg": "uzbekistan",
    "rumania": "romania", "moldavia": "moldova", "macedonia": "north macedonia", "bosnia": "bosnia and herzegovina",
    "kossovo": "kosovo", "ivory coast": "côte d'ivoire", "central africa": "central african republic",
    "zaire": "democratic republic of the congo", "congo2": "republic of congo", "swazi": "eswatini", "surinam": "suriname",
    "saudi": "saudi arabia", "korea": "south korea", "timor": "east timor", "papua": "papua new guinea",
    "luxemburg": "luxembourg", "mbini": "equatorial guinea", "bissau": "guinea-bissau",
}
SHOWN_TAGS = ("admin_level boundary type place disputed wikidata wikipedia color color:id whmid group title:raw leader dynasty note span").split()
SHOWN_PREFIXES = "start_date end_date start_event end_event source note fixme".split()
SITE = "https://www.openhistoricalmap.org"


def parse_title(title: Column | str) -> Column:
    """struct(name, span, leader, dynasty, note) of an atlas title, whose parts stand between commas.

    The name ends at the first part that starts like a year (the span) or holds a range of years.
    Of the parts after it, the first with a range and a family word is the dynasty, and the first
    with a range and a title the leader; more of these are dropped. The last free part before both
    is the leader's own name. All other parts are notes, in order; a free part before both counts
    from where the next such part follows, and a name without a leader comes last. Null for null.
    """
    edges = " \t\r\n"
    parts = F.transform(F.split(title, ","), lambda p: F.rtrim(F.btrim(p, F.lit(edges)), F.lit(".,")))
    never = F.lit(2**31 - 1)

    def first(places: Column) -> Column:
        return F.coalesce(F.get(places, F.lit(0))["i"], never)

    def of(parts: Column) -> Column:
        dated = lambda p: p.rlike(RANGE)
        ends = F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("i"), p.rlike(SPAN).alias("span"), dated(p).alias("dated"))), lambda x: x["span"] | x["dated"])
        return bind(F.struct(parts.alias("parts"), F.coalesce(F.get(ends, F.lit(0))["i"], F.size(parts)).alias("at"), F.coalesce(F.get(ends, F.lit(0))["span"], F.lit(False)).alias("span")), told)

    def told(x: Column) -> Column:
        start = x["at"] + x["span"].cast("int")
        ruler = rf"(?i)\b(?:{'|'.join(TITLES)})\b"
        kind = lambda p: F.when(~p.rlike(RANGE), "free").when(p.rlike(FAMILY), "family").when(p.rlike(ruler), "ruler").otherwise("dated")
        rest = F.filter(F.transform(x["parts"], lambda p, i: F.struct(i.alias("i"), p.alias("p"), kind(p).alias("kind"))), lambda y: y["i"] >= start)
        return bind(F.struct(x["parts"].alias("parts"), x["at"].alias("at"), x["span"].alias("span"), rest.alias("rest")), named)

    def named(x: Column) -> Column:
        kinds = lambda k: F.filter(x["rest"], lambda y: y["kind"] == k)
        known = F.least(first(kinds("ruler")), first(kinds("family")))
        early = F.filter(kinds("free"), lambda y: y["i"] < known)
        return bind(F.struct(*[x[c].alias(c) for c in ("parts", "at", "span", "rest")], known.alias("known"), early.alias("early"),
                             F.get(kinds("ruler"), F.lit(0))["p"].alias("ruler"), F.get(kinds("family"), F.lit(0))["p"].alias("family")), whole)

    def whole(x: Column) -> Column:
        note = lambda i, p: F.struct(i.alias("i"), p.alias("p"))
        later = F.transform(F.filter(x["rest"], lambda y: (y["kind"] == "dated") | ((y["kind"] == "free") & (y["i"] > x["known"]))), lambda y: note(y["i"], y["p"]))
        moved = F.transform(x["early"], lambda y, n: note(F.coalesce(F.get(x["early"], n + 1)["i"], never), y["p"]))
        notes = F.array_sort(F.concat(later, F.filter(moved, lambda y: (y["i"] < never) | x["ruler"].isNull())))
        own = F.get(x["early"], F.size(x["early"]) - 1)["p"]
        return F.struct(
            F.array_join(F.slice(x["parts"], 1, x["at"]), ", ").alias("name"), F.when(x["span"], F.get(x["parts"], x["at"])).alias("span"),
            F.when(x["ruler"].isNotNull(), F.concat_ws(", ", own, x["ruler"])).alias("leader"), x["family"].alias("dynasty"),
            F.nullif(F.array_join(F.transform(notes, lambda y: y["p"]), ", "), F.lit("")).alias("note"))

    return bind(F.filter(parts, lambda p: p != ""), of)


def base_name(title: Column) -> Column:
    """Text before the first comma."""
    return F.trim(F.split_part(title, F.lit(","), F.lit(1)))


def path_id(s: Column) -> Column:
    """struct(id, name) of '123-name'; without a number the id is ''."""
    pattern = r"^(\d+)-(.+)$"
    hit = s.rlike(pattern)
    return F.struct(F.when(hit, F.regexp_extract(s, pattern, 1)).otherwise("").alias("id"), F.when(hit, F.regexp_extract(s, pattern, 2)).otherwise(s).alias("name"))


def country_name(name: Column) -> Column:
    """Lower-cased name, or what the other atlas calls it."""
    low = F.lower(name)
    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(table[low], low)


def escape_html(s: Column) -> Column:
    out = F.replace(s, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def shown(tags: Column) -> Column:
    """Tags that the viewer lists."""
    pattern = rf"^(?:(?:{'|'.join(SHOWN_TAGS)})$|(?:{'|'.join(SHOWN_PREFIXES)}))"
    return F.map_filter(tags, lambda k, _: k.rlike(pattern))


def link_of(key: Column, value: Column) -> Column:
    """The address behind a tag's value, null if there is none."""
    return (F.when(key == "wikipedia", F.concat(F.lit("https://"), F.split_part(value, F.lit(":"), F.lit(1)), F.lit(".wikipedia.org/wiki/"), value))
            .when(key == "color:id", F.concat(F.lit(f"{SITE}/relation/"), value)).when(F.startswith(value, F.lit("https://")), value))


def feature_link(s: Column) -> Column:
    """'r/12' as an address."""
    kind = F.when(F.startswith(s, F.lit("n/")), "node").when(F.startswith(s, F.lit("w/")), "way").otherwise("relation")
    return F.when(s.rlike(r"^[nwr]/\d+$"), F.concat(F.lit(f"{SITE}/"), kind, F.lit("/"), F.split_part(s, F.lit("/"), F.lit(2))))


def level_prefix(level: Column, name: Column) -> Column:
    """'[2] name '; empty parts are left out."""
    a = F.when(F.coalesce(level, F.lit("")) != "", F.concat(F.lit("["), level, F.lit("] "))).otherwise("")
    b = F.when(F.coalesce(name, F.lit("")) != "", F.concat(name, F.lit(" "))).otherwise("")
    return F.concat(a, b)


def earth_years_text(earth_years: Column, name: Column, start: Column, end: Column) -> Column:
    """'0.1234 earth-yr; name (start–end)'."""
    return F.format_string("%.4f earth-yr; %s (%s–%s)", earth_years, name, F.coalesce(start, F.lit("?")), F.coalesce(end, F.lit("present")))


# ------------------------------------------------------------- parameters of a view
def map_view(s: str) -> tuple[float, float, float] | None:
    """zoom, latitude and longitude of 'z/lat/lng'."""
    try:
        zoom, lat, lng = (float(x) for x in s.split("/"))
    except ValueError:
        return None
    return (zoom, lat, lng) if all(abs(x) < float("inf") for x in (zoom, lat, lng)) else None


def id_list(s: str) -> list[float] | None:
    """Numbers of a comma list; others are left out, null if none is left."""
    out = []
    for x in s.split(","):
        try:
            out.append(float(x.strip() or 0))
        except ValueError:
            continue
    return out or None


def year_range(s: str, least: int = -6000, most: int = 2026) -> tuple[int, int] | None:
    m = re.match(r"\s*(-?\d+)[^,]*,\s*(-?\d+)[^,]*$", s)
    if not m or not least <= int(m[1]) < int(m[2]) <= most:
        return None
    return int(m[1]), int(m[2])


def level_set(s: str) -> set[str] | None:
    return {x for x in s.split(",") if re.fullmatch(r"\d+", x)} or None
