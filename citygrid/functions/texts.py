"""Small text and date expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that outputs don't carry, and roles.
PARTIES = (
    "Bharatiya Janata Party", "BJP", "Indian National Congress", "Congress", "INC", "Aam Aadmi Party", "AAP", "Samajwadi Party", "Bahujan Samaj Party", "BSP",
    "Trinamool Congress", "TMC", "AITC", "DMK", "AIADMK", "CPI(M)", "CPI", "Shiv Sena", "Nationalist Congress Party", "NCP", "Janata Dal (United)", "JD(U)", "JD(S)",
    "Rashtriya Janata Dal", "RJD", "Telugu Desam Party", "TDP", "YSR Congress", "YSRCP", "Bharat Rashtra Samithi", "BRS", "Biju Janata Dal", "BJD", "AIMIM", "JMM", "MNS",
)
ROLES = "chief minister|deputy chief minister|cabinet minister|union minister|minister|MLA|MP|CM|PM|prime minister|mayor|opposition leader"


def alternatives(names: tuple[str, ...]) -> str:
    """A pattern of the names, the longest first, as alternatives are tried in order."""
    return "|".join(re.sub(r"([()])", r"\\\1", p) for p in sorted(names, key=len, reverse=True))


PARTY_SQL = alternatives(PARTIES)


def redact(text: Column, names: tuple[str, ...] = PARTIES) -> Column:
    return F.regexp_replace(text, f"(?<![A-Za-z])({alternatives(names)})(?![A-Za-z])", "[party]")


def without_roles(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?i)\b({ROLES})\b", "an official")


def normal_place(place: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(place), "[^a-z0-9]+", " "))


def is_whole_city(place: Column, names: tuple[str, ...]) -> Column:
    """Whether nothing is left of a normalised place without the names of its city."""
    every = "|".join([*(re.escape(n.lower()) for n in names), "city", "india"])
    return F.btrim(F.regexp_replace(place, rf"\b({every})\b", ""), F.lit(" ,-")) == ""


def places(text: Column) -> Column:
    """The first three places that a location names, those of three letters and more."""
    parts = F.transform(F.split(text, r"\s*(?:-|–|,|/|\bto\b|\band\b)\s*"), lambda p: F.trim(p))
    return F.filter(F.slice(parts, 1, 3), lambda p: F.length(p) >= 3)


def without_source(title: Column, source: Column) -> Column:
    tail = F.concat(F.lit(" - "), source)
    return F.when(F.endswith(title, tail), F.substring(title, F.lit(1), F.length(title) - F.length(tail))).otherwise(title)


def utc(text: Column) -> Column:
    """`20240131T120000Z` and `Wed, 31 Jan 2024 17:30:00 +0530` as `2024-01-31 12:00:00` in UTC; null for anything else."""
    compact = F.try_to_timestamp(F.regexp_replace(text, "Z$", "+0000"), F.lit("yyyyMMdd'T'HHmmssxx"))
    mail = F.try_to_timestamp(F.regexp_extract(text, r"^\w{3}, (.*)$", 1), F.lit("dd MMM yyyy HH:mm:ss xx"))
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.coalesce(compact, mail).cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")


def same_score(x: Column, y: Column) -> Column:
    """Both zero, or of one sign and within a quarter of the larger."""
    near = (F.signum(x) == F.signum(y)) & (F.abs(x - y) <= 0.25 * F.greatest(F.abs(x), F.abs(y)))
    return ((x == 0) & (y == 0)) | near


def audit(cases: DataFrame) -> DataFrame:
    """(tested, identical, invariance, score_invariance) of cases(x, y): scores of a first and a second reading."""
    x, y = F.col("x"), F.col("y")
    share = lambda c: F.avg(c.cast("double"))
    return cases.agg(F.count("*").alias("tested"), F.count_if(x == y).alias("identical"), share(x == y).alias("invariance"), share(same_score(x, y)).alias("score_invariance"))


def mollweide_theta_sql(lat: str) -> str:
    """The auxiliary angle by five Newton steps, as nested SQL."""
    t = f"(({lat}) * 0.8)"
    for _ in range(5):
        t = f"({t} - (2 * {t} + sin(2 * {t}) - pi() * sin({lat})) / (2 + 2 * cos(2 * {t})))"
    return t
