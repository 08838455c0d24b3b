"""Text as it comes in feeds: names, colours, addresses, mark-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "ndash": "–", "mdash": "—", "hellip": "…", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß"}


def html_decoded(text: Column) -> Column:
    """Named references that feeds use, in SQL; ``&amp;`` last, so that nothing is decoded twice. [F14]"""
    for name, char in _ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def tags_removed(html: Column) -> Column:
    """Text of a piece of mark-up: scripts, styles and tags out, references decoded, white space joined. [F31, D46]"""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(html_decoded(text), r"\s+", " "))


def tag_block(xml: Column, tag: str) -> Column:
    """Contents of all elements of a name, in order. [F31]"""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<(?:[a-zA-Z0-9]+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:[a-zA-Z0-9]+:)?{tag}>"), F.lit(1))


def shortened_name(name: Column, words: tuple[str, ...] = ("station", "gare", "train", "metro", "railway", "subway")) -> Column:
    """A name without the words that most names share. [F12]"""
    return F.trim(F.regexp_replace(F.regexp_replace(name, rf"(?i)\b(?:{'|'.join(words)})\b", " "), r"\s+", " "))


def id_without_timestamp(ident: Column, header: Column) -> Column:
    """An entity id without the header's timestamp, and without one dash or underscore at either end. [F9]"""
    bare = F.when(header.isNull(), ident).otherwise(F.replace(ident, header.cast("string"), F.lit("")))
    return F.regexp_replace(bare, r"^[-_]|[-_]$", "")


def hyphen_trimmed(route_id: Column) -> Column:
    """A route id up to its first hyphen. [F10]"""
    return F.substring_index(route_id, "-", 1)


def translations(json: Column) -> Column:
    """A JSON object as a map of strings. [F13]"""
    return F.from_json(json, "map<string,string>")


def host_of(url: Column) -> Column:
    """Lower-cased host, null if there is none. [F32]"""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def domain_label(url: Column) -> Column:
    """The label before a host's last one, as 'example' of 'www.example.org'. [F32, D35]"""
    labels = F.split(host_of(url), r"\.")
    return F.when(F.size(labels) >= 2, F.get(labels, F.size(labels) - 2))


def registrable_label(url: Column) -> Column:
    """The name part of an address's host, with or without a scheme: the label before 'org', or before 'co.uk'. [F32, D35]"""
    host = F.coalesce(host_of(url), host_of(F.concat(F.lit("https://"), url)))
    labels = F.filter(F.split(F.regexp_replace(host, r"\.+$", ""), r"\."), lambda x: x != "")
    n = F.size(labels)
    double = (n >= 3) & (F.char_length(F.try_element_at(labels, F.lit(-1))) == 2) & F.try_element_at(labels, F.lit(-2)).isin("ac", "co", "com", "edu", "gov", "net", "org")
    found = F.when(n == 1, F.get(labels, F.lit(0))).when(double, F.get(labels, n - 3)).otherwise(F.get(labels, n - 2))
    return F.when(~host.rlike(r"^[0-9.]+$|^\["), found)


def unified_agency_id(name: Column, url: Column, generic: list[str]) -> Column:
    """One id for an agency in all feeds: of a generic name its address's label, else the name with '_' for blanks. [D35]"""
    label = F.when(F.lower(F.trim(name)).isin([g.strip().lower() for g in generic]), registrable_label(url))
    return F.coalesce(label, F.replace(name, F.lit(" "), F.lit("_")))


def file_safe(name: Column) -> Column:
    """A name as part of a file name. [F33]"""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def xml_escaped(text: Column) -> Column:
    """[F33]"""
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        text = F.replace(text, F.lit(char), F.lit(f"&{name};"))
    return text


def hex_colour(colour: Column, default: str) -> Column:
    """'RRGGBB' in capitals; ``default`` for none, white or what isn't a colour. [F27, P16]"""
    bare = F.upper(F.regexp_replace(F.trim(colour), "^#", ""))
    return F.when(bare.rlike("^[0-9A-F]{6}$") & (bare != "FFFFFF"), bare).otherwise(F.lit(default))


def contrast_colour(colour: Column) -> Column:
    """Black or white, whichever reads better on a colour. [F27]"""
    red, green, blue = (F.conv(F.substring(colour, i, 2), 16, 10).cast("int") for i in (1, 3, 5))
    return F.when(red * 299 + green * 587 + blue * 114 >= 128_000, F.lit("000000")).otherwise(F.lit("FFFFFF"))


def kml_colour(colour: Column) -> Column:
    """'aabbggrr' of 'RRGGBB'. [F27]"""
    return F.lower(F.concat(F.lit("ff"), F.substring(colour, 5, 2), F.substring(colour, 3, 2), F.substring(colour, 1, 2)))


def metres_per_second(mph: Column) -> Column:
    """[F30]"""
    return mph.cast("double") * 0.44704


def headsign_index(headsigns: Column) -> Column:
    """Struct of the distinct headsigns of a trip's stops and each stop's index in them; null if there is one only. [F11]"""
    names = F.array_distinct(headsigns)
    return F.when(F.size(names) > 1, F.struct(names.alias("names"), F.transform(headsigns, lambda h: (F.array_position(names, h) - 1).cast("int")).alias("index")))


def title_case(text: Column) -> Column:
    """[F34]"""
    return F.initcap(F.lower(F.trim(text)))


def station_number(text: Column) -> Column:
    """The number of a Swiss station from its 'ch:1:sloid:7000', UIC '8507000' or plain form; null if there is none. [F35]"""
    sloid = F.regexp_extract(text, r"^ch:1:sloid:([0-9]+)", 1)
    uic = F.regexp_extract(text, r"^85([0-9]{5})(?::.*)?$", 1)
    plain = F.regexp_extract(text, r"^0*([1-9][0-9]{0,4})(?::.*)?$", 1)
    return F.when(sloid != "", sloid.cast("int")).when(uic != "", uic.cast("int")).when(plain != "", plain.cast("int"))


def language_of(text: Column) -> Column:
    """Guess among a few languages by their commonest words. [F15]"""
    words = {"en": "the|and|of|is|to", "fr": "le|la|les|des|est|et", "de": "der|die|das|und|ist", "es": "el|los|las|que|es|y"}
    counts = [F.struct(F.regexp_count(F.lower(text), F.lit(rf"\b(?:{w})\b")).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("lang")) for i, (k, w) in enumerate(words.items())]
    best = F.greatest(*counts)
    return F.when(best["n"] > 0, best["lang"])


def token_overlap(one: Column, other: Column) -> Column:
    """Share of the tokens (two letters or more) of the shorter list that the other has. [F16]"""
    a, b = (F.array_distinct(F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: F.char_length(w) >= 2)) for x in (one, other))
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)
