"""Words of texts in a form that ignores case, accents, punctuation, line marks and spacing."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Letters whose decomposition is one plain letter and marks, with that letter (rule: Unicode NFD)."""
    plain, marked = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code).lower())
        if len(base) > 1 and base[0].isalpha() and all(unicodedata.combining(c) for c in base[1:]):
            marked.append(chr(code).lower())
            plain.append(base[0])
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _folding()


def folded(text: Column) -> Column:
    """Lower case without accents, soft hyphens and invisible marks; plain ASCII needs no more than lower case."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(_folded(text))


def _folded(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), r"[\p{M}­​-‍⁠﻿]", "")
    out = F.translate(out, _MARKED, _PLAIN)
    return F.replace(F.replace(F.replace(out, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))


def words(text: Column) -> Column:
    """Array of the words (runs of letters and digits) of a text; empty for NULL."""
    return F.coalesce(F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))
