"""What Spark has no expression for: Unicode forms, marks, scripts. Arrow batches, one hop each."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of these characters alone are the same in NFC (and NFKC, where only ASCII counts), so they stay in the JVM.
_STABLE = {"NFC": r"^[\x00-\x{2FF}\x{400}-\x{482}\x{48A}-\x{52F}\x{1200}-\x{135A}\x{1360}-\x{137C}\x{3041}-\x{3094}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}\x{3001}-\x{3003}\x{FF01}-\x{FF5E}]*$"}
_ASCII = r"^[\x00-\x7F]*$"


def _apply(c: Column, stable: str, f: Callable[[str], str]) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(t) for t in texts.to_pylist()], pa.string())

    fits = c.rlike(stable)
    return F.when(fits, c).otherwise(run(F.when(~fits, c)))


def unicode_form(c: Column, form: str = "NFC") -> Column:
    """NFC, NFD, NFKC or NFKD of a text; null stays null."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown Unicode form: {form}")
    return _apply(c, _STABLE.get(form, _ASCII), lambda t: unicodedata.normalize(form, t))


def _without(drop: Callable[[str], bool]) -> Callable[[str], str]:
    def run(t: str) -> str:
        return unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", t) if not drop(x)))

    return run


def strip_marks(c: Column) -> Column:
    """Without nonspacing marks (category Mn)."""
    return _apply(c, _ASCII, _without(lambda x: unicodedata.category(x) == "Mn"))


def strip_diacritics(c: Column) -> Column:
    """Without characters that combine (class other than 0)."""
    return _apply(c, _ASCII, _without(lambda x: unicodedata.combining(x) != 0))


def _script(text: str) -> str | None:
    counts: dict[str, int] = {}
    for ch in text:
        if ch.isalpha():
            name = unicodedata.name(ch, "").split(" ")[0]
            if name:
                counts[name] = counts.get(name, 0) + 1
    return max(counts, key=counts.__getitem__) if counts else None


def dominant_script(c: Column) -> Column:
    """First word of most letters' Unicode names, the first one seen on ties; null without letters."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _script(t) for t in texts.to_pylist()], pa.string())

    latin = c.rlike(r"^[\x00-\x{24F}&&[^\xAA\xBA\xB5\x{2B0}-\x{2FF}]]*$")
    return F.when(latin & c.rlike(r"\p{IsLatin}"), F.lit("LATIN")).when(latin, F.lit(None)).otherwise(run(F.when(~latin, c)))
