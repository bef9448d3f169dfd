"""Tagging of question texts with plain string expressions.

Keyword tests look for substrings, so "versus" also answers to "vs" and
"most" is found in "almost"; that is how questions are routed. ``text`` is the
name of a column of lower-case texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and keywords, in the order they are tried.
HOUR_PATTERNS = (
    (r"(\d{1,2})\s*pm", "pm"),
    (r"(\d{1,2})\s*am", "am"),
    (r"(\d{1,2}):00", ":00"),
    (r"hour\s+(\d{1,2})", "hour"),
)
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
DAY_PARTS = ("morning", "afternoon", "evening", "night")
ZONE_PATTERN = r"\b(zone|cluster)\s*(\d+)"
NUMBER_PATTERN = r"\b(\d+)\b"
LOOKUP_PATTERN = r"zone\s+(\d+)"
COMPARE = ("compare", "versus", "vs", "vs.", "difference between")
DEPLOY = ("deploy", "allocate", "send", "position", "station")
DEPLOYED = ("driver", "car", "vehicle", "resource")
PEAK = ("maximum", "max", "most", "highest", "where should i", "should i be")
PEAK_OF = ("ride", "demand", "trip")
HIGH = ("highest", "best", "top", "maximum")
HIGH_REVENUE = ("revenue", "potential", "profitable")
HIGH_DEMAND = ("demand", "rides", "trips", "busy")
LOW = ("lowest", "worst", "bottom", "minimum", "weakest")
LOW_DEMAND = ("demand", "rides", "trips")
LOW_REVENUE = ("revenue", "profit", "performance")
IMPROVE = ("improve", "focus", "optimize", "fix")
PRICING = ("price increase", "pricing", "raise price", "increase price", "fare increase")
PRICING_ASK = ("benefit", "should", "recommend", "which zone")
OPEN_ZONE = ("which zone", "what zone")
OVERALL = ("average", "overall")
MARGIN = ("profit", "margin")


def has_any(text: str, words: Sequence[str]) -> Column:
    return F.expr(" or ".join(f"contains({text}, '{w}')" for w in words))


def asked_hour(text: str) -> Column:
    """Hour named in the text, from the first pattern that matches.

    Most texts lack a pattern's literal part, which is far cheaper to look for.
    """
    options = []
    for pattern, literal in HOUR_PATTERNS:
        hour = F.when(has_any(text, [literal]), F.regexp_extract(text, pattern, 1).try_cast("int"))
        if literal == "pm":
            hour = F.when(hour == 12, F.lit(12)).otherwise(hour + 12)
        elif literal == "am":
            hour = F.when(hour == 12, F.lit(0)).otherwise(hour)
        options.append(hour)
    return F.coalesce(*options)


def _first_word(text: str, words: Sequence[str], values: Sequence) -> Column:
    tests = " ".join(f"when contains({text}, '{w}') then {v!r}" for w, v in zip(words, values))
    return F.expr(f"case {tests} end")


def asked_weekday(text: str) -> Column:
    return _first_word(text, WEEKDAYS, range(7))


def asked_day_part(text: str, hour: Column) -> Column:
    """Part of the day, only where no hour is named."""
    return F.when(hour.isNull(), _first_word(text, DAY_PARTS, DAY_PARTS))


def _as_ids(found: Column) -> Column:
    return F.transform(found, lambda digits: digits.try_cast("bigint"))


def named_zones(text: str) -> Column:
    """Zone ids after "zone" or "cluster"; the plural form is not seen."""
    found = _as_ids(F.regexp_extract_all(text, F.lit(ZONE_PATTERN), F.lit(2)))
    return F.when(has_any(text, ["zone", "cluster"]), found).otherwise(F.array().cast("array<bigint>"))


def numbers(text: str) -> Column:
    return _as_ids(F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), F.lit(1)))


def intent(text: str, known: Column, hour: Column, weekday: Column, zones: Column, high: Column, low: Column) -> Column:
    """What the question asks for, by the first rule that applies.

    ``known`` is the array of zone ids with data, ``zones`` the ids named in
    the text, ``high`` and ``low`` tell whether it has such keywords. They and
    "improve" exclude each other: a question with a high keyword is never
    tested for the others.
    """
    pair = numbers(text)
    both_known = F.array_contains(known, F.get(pair, F.lit(0))) & F.array_contains(known, F.get(pair, F.lit(1)))
    open_time = hour.isNull() & weekday.isNull()
    low = ~high & low
    rest = ~high & ~low
    ladder = (
        (F.exists(zones, lambda z: ~F.coalesce(F.array_contains(known, z), F.lit(False))), "unknown_zone"),
        (has_any(text, COMPARE) & (F.size(pair) >= 2) & both_known, "compare"),
        (has_any(text, DEPLOY) & has_any(text, DEPLOYED), "deployment"),
        (has_any(text, PEAK) & has_any(text, PEAK_OF), "peak_cell"),
        (open_time & high & has_any(text, HIGH_REVENUE), "top_revenue"),
        (open_time & high & has_any(text, HIGH_DEMAND), "top_demand"),
        (open_time & low & has_any(text, LOW_DEMAND), "bottom_demand"),
        (open_time & low & has_any(text, LOW_REVENUE), "bottom_revenue"),
        (open_time & rest & has_any(text, IMPROVE), "improvement"),
        (has_any(text, PRICING) & has_any(text, PRICING_ASK), "price_increase"),
    )
    chain = None
    for test, name in ladder:
        test = F.coalesce(test, F.lit(False))
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return chain.otherwise(F.lit("general"))
