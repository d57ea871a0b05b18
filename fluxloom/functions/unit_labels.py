"""Reading units out of labels and prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factor from each unit to the common unit (ppb, kg/h; a year has 8760 h).
MOLE_FRACTION = {"ppb": 1.0, "ppm": 1e3, "ppt": 1e-3, "percent": 1e7, "mol/mol": 1e9}
RATE = {"kg/h": 1.0, "t/h": 1e3, "g/s": 3.6, "lb/h": 0.45359237, "kt/yr": 1e6 / 8760.0}

# Spellings of the units.
_FRACTION_PATTERNS = {
    "ppb": r"\bppbv?\b|parts per billion|nmol|nanomol|^1e-0?9$",
    "ppm": r"\bppmv?\b|parts per million|umol|µmol|μmol|micromol|^1e-0?6$",
    "ppt": r"\bpptv?\b|parts per trillion|pmol|picomol|^1e-12$",
    "percent": r"%|per ?cent|^1e-0?2$",
    "mol/mol": r"^1$|^1\.0$|mole fraction|\bmol\b.*\bmol\b",
}
_HOUR = r"\s*(?:/|per\b|an?\b)?\s*(?:h|hr|hour|hourly)(?![a-z])"
_RATE_PATTERNS = {
    "kt/yr": r"\b(?:kt|gg|kilotonnes?|kilotons?)\s*(?:/|per\b|an?\b)?\s*(?:y|yr|year|a|annum)(?![a-z])",
    "lb/h": r"\b(?:lbs?|pounds?)" + _HOUR,
    "kg/h": r"\bkgh\b|\b(?:kgs?|kilograms?)(?:\s+ch4)?" + _HOUR,
    "g/s": r"\b(?:g|grams?)\s*(?:/|per\b|an?\b)?\s*(?:s|sec|second)(?![a-z])",
    "t/h": r"\b(?:t|mg|tonnes?|tons?)" + _HOUR,
}


def _match(text: Column, patterns: dict[str, str]) -> Column:
    low = F.lower(F.trim(text))
    out = None
    for unit, pattern in patterns.items():
        hit = low.rlike(pattern)
        out = F.when(hit, unit) if out is None else out.when(hit, unit)
    return out


def fraction_unit(label: Column) -> Column:
    """Mole-fraction unit named by a label; NULL when it names none."""
    return _match(label, _FRACTION_PATTERNS)


def rate_unit(text: Column) -> Column:
    """Emission-rate unit named by a label or a sentence; NULL when it names none."""
    return _match(text, _RATE_PATTERNS)


def factor(unit: Column, factors: dict[str, float]) -> Column:
    """Conversion factor of a unit; NULL for an unknown one."""
    return F.create_map(*[F.lit(x) for kv in factors.items() for x in kv])[unit]
