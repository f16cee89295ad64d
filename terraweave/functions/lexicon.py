"""Spatial cues: canonical values, semantic types and relation types.

The tables are data; the functions turn a table into one CASE expression, so
mapping a cue costs no join and no Python.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from .text import col, fold, strip

# ---------------------------------------------------------------------------
# Cue patterns and the region-connection label they stand for,
# tried from top to bottom.
# ---------------------------------------------------------------------------
TOPOLOGY = [
    (r"\b(inside|within|in the|in a|in)\b", "NTPP"),
    (r"\b(contains?|houses?|holds?)\b", "NTPPi"),
    (r"\b(part of|belongs to|member of)\b", "TPP"),
    (r"\b(at|on)\b", "TPP"),
    (r"\b(adjacent to|next to|next door|beside|by|alongside|bordering|borders|on the edge of|on the border of)\b", "EC"),
    (r"\b(across from|opposite|facing)\b", "DC"),
    (r"\b(near|close to|not far from|nearby)\b", "EC"),
    (r"\b(far from|away from|distant from|miles? from|kilometers? from)\b", "DC"),
    (r"\b(beyond|past|outside)\b", "DC"),
    (r"\b(overlapping|crosses|crossing)\b", "PO"),
    (r"\b(same as|identical to|equal to)\b", "EQ"),
]

# Cue patterns and the cardinal direction they stand for.
DIRECTION = [
    (r"\bnorth(?:east|west)?\s+of\b", "N"),
    (r"\bsouth(?:east|west)?\s+of\b", "S"),
    (r"\beast of\b", "E"),
    (r"\bwest of\b", "W"),
    (r"\babove\b", "N"),
    (r"\bbelow\b", "S"),
    (r"\bleft of\b", "W"),
    (r"\bright of\b", "E"),
]

# Fixed value: number and unit of a distance.
DISTANCE = r"(\d+(?:\.\d+)?)\s*(miles?|mi|kilometers?|kms?|km|meters?|m|feet|ft|yards?|yd)\b"

# The short tables used when a named lexicon file is missing.
TOPOLOGY_SHORT = [
    (r"\b(inside|within|in the|in a|in)\b", "NTPP"),
    (r"\b(contains?|houses?|holds?)\b", "NTPPi"),
    (r"\b(at|on|part of)\b", "TPP"),
    (r"\b(near|next to|adjacent to|beside)\b", "EC"),
    (r"\b(across from|far from|beyond)\b", "DC"),
]
DIRECTION_SHORT = [
    (r"\bnorth(?:east|west)?\s+of\b", "N"),
    (r"\bsouth(?:east|west)?\s+of\b", "S"),
    (r"\beast of\b", "E"),
    (r"\bwest of\b", "W"),
]

# The closed label sets.
TOPOLOGY_LABELS = ["DC", "EC", "PO", "EQ", "TPP", "NTPP", "TPPi", "NTPPi"]
DIRECTION_LABELS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW", "EQ"]
SEMANTIC_TYPES = ["REGION", "DIRECTION", "DISTANCE"]

# Cue phrases and their semantic type.
CUE_TYPES = {
    "in": "REGION", "on": "REGION", "inside": "REGION", "outside": "REGION",
    "within": "REGION", "behind": "REGION", "in front of": "REGION",
    "between": "REGION", "among": "REGION", "above": "REGION", "below": "REGION",
    "beneath": "REGION", "under": "REGION", "underneath": "REGION",
    "on top of": "REGION", "to the left of": "REGION", "to the right of": "REGION",
    "at": "REGION",
    "toward": "DIRECTION", "towards": "DIRECTION", "into": "DIRECTION",
    "onto": "DIRECTION", "through": "DIRECTION", "across": "DIRECTION",
    "away from": "DIRECTION", "out of": "DIRECTION", "up": "DIRECTION",
    "down": "DIRECTION", "along": "DIRECTION",
    "near": "DISTANCE", "close to": "DISTANCE", "far from": "DISTANCE",
    "next to": "DISTANCE", "beside": "DISTANCE", "adjacent to": "DISTANCE",
    "by": "DISTANCE",
}

# Idioms that look spatial but are not.
METAPHORS = [
    "in love", "in trouble", "in charge", "in mind", "in time",
    "on time", "on edge", "in danger", "in luck",
]

# Relation types of the joint extractor, and those that may
# stand without a second entity.
RELATION_TYPES = [
    "near", "far", "north_of", "south_of", "east_of", "west_of",
    "across", "on_coast", "within", "contains", "part_of", "borders",
    "on_shore_of", "connected_via", "distance_approx",
]
UNARY_TYPES = ["on_coast"]

# Our own defaults: the relation type the rule-based joint extractor reads
# from a cue phrase it can type.
CUE_RELATIONS = {
    "near": "near", "close to": "near", "next to": "near", "beside": "near",
    "by": "near", "adjacent to": "borders", "far from": "far", "away from": "far",
    "across": "across", "in": "within", "inside": "within", "within": "within",
    "at": "within", "on": "on_shore_of", "through": "connected_via",
    "along": "connected_via", "above": "north_of", "below": "south_of",
    "to the left of": "west_of", "to the right of": "east_of",
    "north of": "north_of", "south of": "south_of", "east of": "east_of", "west of": "west_of",
}


@dataclass(frozen=True)
class Lexicon:
    topology: list = field(default_factory=lambda: list(TOPOLOGY))
    direction: list = field(default_factory=lambda: list(DIRECTION))
    distance: str | None = DISTANCE


def load(path: str | None = None) -> Lexicon:
    """Lexicon from a YAML or JSON file with keys rcc8, cdc, distance.

    A missing or empty file gives the short built-in tables; a file without a
    distance pattern never yields a distance.
    """
    if path is None:
        return Lexicon()
    data = None
    if os.path.exists(path):
        with open(path, encoding="utf-8") as handle:
            body = handle.read()
        try:
            import yaml
            data = yaml.safe_load(body)
        except ImportError:
            data = json.loads(body)
    if not data:
        return Lexicon(list(TOPOLOGY_SHORT), list(DIRECTION_SHORT), DISTANCE)
    rows = lambda key: [(r["pattern"], r["label"]) for r in data.get(key) or []]
    return Lexicon(rows("rcc8"), rows("cdc"), (data.get("distance") or {}).get("pattern"))


def _first_match(cue: Column, table: list, value) -> Column:
    out = None
    for pattern, label in table:
        hit, v = cue.rlike(pattern), value(pattern, label)
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return F.lit(None).cast("string") if out is None else out


def topology(cue: Column, lexicon: Lexicon) -> Column:
    return _first_match(cue, lexicon.topology, lambda p, label: F.lit(label))


def direction(cue: Column, lexicon: Lexicon) -> Column:
    """First matching direction; north/south become diagonal when the matched words say so."""
    def refined(pattern, label):
        if label not in ("N", "S"):
            return F.lit(label)
        words = F.regexp_extract(cue, f"({pattern})", 1)
        return (
            F.when(F.contains(words, F.lit("east")), F.lit(label + "E"))
            .when(F.contains(words, F.lit("west")), F.lit(label + "W"))
            .otherwise(F.lit(label))
        )
    return _first_match(cue, lexicon.direction, refined)


def distance(cue: Column, lexicon: Lexicon) -> tuple[Column, Column]:
    if lexicon.distance is None:
        return F.lit(None).cast("double"), F.lit(None).cast("string")
    pick = lambda g: F.nullif(F.regexp_extract(cue, lexicon.distance, g), F.lit(""))
    return pick(1).cast("double"), pick(2)


def map_cue(cue: Column | str, lexicon: Lexicon | None = None) -> dict[str, Column]:
    """Canonical values of a free-text cue, null where nothing matches."""
    lexicon = lexicon or Lexicon()
    key = strip(F.lower(F.coalesce(col(cue), F.lit(""))))
    value, unit = distance(key, lexicon)
    return {
        "rcc8": topology(key, lexicon),
        "cdc": direction(key, lexicon),
        "distance_value": value,
        "distance_unit": unit,
    }


def link_kind(cdc: Column) -> Column:
    return F.when(cdc.isNotNull(), "OLINK").otherwise("QSLINK")


def edge_label(rcc8: Column, cdc: Column, value: Column, unit: Column, cue: Column) -> Column:
    """``rcc8 / cdc / distance``, else the cue itself, else ``?``."""
    reach = F.concat(value.cast("string"), F.coalesce(unit, F.lit("")))
    joined = F.concat_ws(" / ", rcc8, cdc, reach)
    return F.coalesce(F.nullif(joined, F.lit("")), F.nullif(cue, F.lit("")), F.lit("?"))


def infer_type(cue: Column | str) -> Column:
    """Semantic type of a cue: exact phrase, else the longest phrase that
    contains the cue or is contained in it; null when there is none."""
    key = fold(cue)
    exact = None
    for phrase, kind in CUE_TYPES.items():
        exact = F.when(key == phrase, kind) if exact is None else exact.when(key == phrase, kind)
    near = None
    for phrase in sorted(CUE_TYPES, key=len, reverse=True):
        hit = F.contains(key, F.lit(phrase)) | F.contains(F.lit(phrase), key)
        near = F.when(hit, CUE_TYPES[phrase]) if near is None else near.when(hit, CUE_TYPES[phrase])
    return F.coalesce(exact, near)


def clean_types(types: Column, cue: Column) -> Column:
    """Valid types upper-cased, distinct and sorted; inferred from the cue when none is valid."""
    upper = F.transform(F.coalesce(types, F.array().cast("array<string>")), F.upper)
    valid = F.array_sort(F.array_distinct(F.filter(upper, lambda t: t.isin(SEMANTIC_TYPES))))
    guess = infer_type(cue)
    return (
        F.when(F.size(valid) > 0, valid)
        .when(guess.isNotNull(), F.array(guess))
        .otherwise(F.array().cast("array<string>"))
    )


def metaphorical(sentence: Column, cue: Column, landmark: Column) -> Column:
    text, pair = fold(sentence), F.concat(fold(cue), F.lit(" "), fold(landmark))
    out = F.lit(False)
    for idiom in METAPHORS:
        out = out | (F.contains(text, F.lit(idiom)) & F.contains(pair, F.lit(idiom)))
    return out


def relation_of(cue: Column) -> Column:
    out = None
    for phrase, kind in CUE_RELATIONS.items():
        out = F.when(cue == phrase, kind) if out is None else out.when(cue == phrase, kind)
    return out
