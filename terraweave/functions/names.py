"""Name filters and classes of place entities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

# ---------------------------------------------------------------------------
# Places known to be invented, and names that are never places.
# ---------------------------------------------------------------------------
FICTIONAL = ["East Egg", "West Egg", "Valley of Ashes", "Eggs"]

BLOCKED = [
    "Jordan", "Myrtle", "Chester", "Daisy", "Daisy's", "Gatsby", "Gatsby's", "Tom", "Nick", "Wilson",
    "Wolfsheim", "Eckhaust", "Katspaugh", "the De Jongs", "Kellehers", "Buchanan", "Baker", "Meyer",
    "Klipspringer", "the Gasoline Pump", "the enchanted metropolitan twilight", "Georgian Colonial",
    "Baedeker", "Beluga", "colocasie", "syphiliticos morbos", "Iviartea", "Jriartea", "Paullinia",
    "Piscidia Evythrina", "Bignonia chica", "Wullschlaegelia", "Rutacea", "Siphonia elastica",
    "the Siphonia elastica", "Bothrops", "pomatum", "Kintinc AN ALLIGATOR", "THE WILD INDIAN", "East",
    "the Middle West", "the fresher sea", "milreis",
]

# Names, endings and beginnings that mark a real place.
REAL = [
    "New York", "Long Island", "Manhattan", "Brooklyn", "Queens", "Bronx", "Connecticut", "New Jersey",
    "Chicago", "London", "Paris", "Europe", "America", "United States", "Oxford", "Louisville",
    "Minnesota", "Santa Barbara", "San Francisco", "Venice", "Rome", "Ohio", "Indiana", "Missouri",
    "Normandy", "Marseilles", "Versailles", "Castile", "France", "England", "Germany", "Spain", "Italy",
    "Brazil", "Rio de Janeiro", "Manaus", "Amazon", "Madeira", "Bolivia", "Peru", "Buenos Aires",
    "Montenegro", "Wisconsin", "Lake Superior", "Lake Michigan", "Atlantic", "Pacific", "Mediterranean",
    "Fifth Avenue", "Broadway", "Wall Street", "Central Park",
]
REAL_MORE = ["São Paulo", "Sao Paulo", "Belém", "Belem", "Pará", "Para"]
ENDINGS = ["City", " Island", " River", " Lake", " Street", " Avenue", " Road", " Bay", " County",
           " State", " Ocean", " Sea", " Mountain", " Mountains", " Valley"]
ENDINGS_MORE = [" Islands", " Province", " Creek", " Harbor", " Harbour", " Port", " Bridge",
                " Station", " Airport"]
BEGINNINGS = ["Lake ", "Mount ", "Cape ", "Port ", "Fort ", "San ", "São ", "Rio ", "Sierra ", "Serra "]

# What scanning errors look like.
ORDINAL = r"(?i)^\d+\s*(?:st|nd|rd|th)\s+"
ODD = r"[&@#$%^*+=<>{}\[\]|\\~`]"


def ends(name: Column, tails: list[str]) -> Column:
    return name.rlike("(?:" + "|".join(tails) + ")$")


def entity_class(name: Column, hint: Column | None = None, fictional: list[str] = FICTIONAL) -> Column:
    """real / fictional / uncertain, from overrides, the model's hint, known names and endings."""
    out = F.when(name.isin(fictional), "fictional")
    if hint is not None:
        h = F.lower(strip(hint))
        out = out.when(h == "fictional", "fictional").when(h == "real", "real")
    return out.when(name.isin(REAL) | ends(name, ENDINGS), "real").otherwise("uncertain")


def entity_class_wide(name: Column, fictional: list[str] = FICTIONAL) -> Column:
    """The same without a hint, with more names and endings, and with beginnings."""
    real = (name.isin(REAL + REAL_MORE) | ends(name, ENDINGS + ENDINGS_MORE)
            | name.rlike("^(?:" + "|".join(BEGINNINGS) + ")"))
    return F.when(name.isin(fictional), "fictional").when(real, "real").otherwise("uncertain")


def scan_error(name: Column) -> Column:
    return (F.length(name) < 3) | (name.rlike(r"\d") & ~name.rlike(ORDINAL)) | name.rlike(ODD)


def not_a_place(name: Column) -> Column:
    bare = strip(name)
    low = F.lower(bare)
    return ((F.length(low) <= 2) | low.rlike("['’]s$")
            | (~F.contains(bare, F.lit(" ")) & bare.rlike(r"^\p{Ll}")))


def plausible(name: Column, mentions: Column, min_mentions: int = 2, blocked: list[str] = BLOCKED,
              fictional: list[str] = FICTIONAL) -> Column:
    return (~name.isin(blocked) & ~scan_error(name) & ~not_a_place(name)
            & ((mentions >= min_mentions) | name.isin(fictional)))
