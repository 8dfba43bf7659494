"""Feature names carry lineage; these helpers build and read them."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

DIV_RATIO = "_div_ratio_"
DUMMY = "_dummie_"
BINNED = "_binned"

# Text replaced, in this order, to turn a bin label into a usable column name.
NAME_REPLACEMENTS = (
    ("<", "less_than"),
    (">", "more_than"),
    (",", "_to_"),
    ("[", "from_incl_"),
    ("]", "_incl_"),
    ("(", "from_excl_"),
    (")", "_excl_"),
    (" ", ""),
)

# Marks that join the two inputs of a combined feature.
RATIO_MARKS = ("_div_ratio_", "_add_ratio_", "_subs_ratio_", "_mult_ratio_")


def sanitize(name: str) -> str:
    for text, word in NAME_REPLACEMENTS:
        name = name.replace(text, word)
    return name


def unique(names: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(names))


def raw_inputs(features: Iterable[str]) -> list[str]:
    """Raw columns behind a list of features, each once, in order of first use."""
    raw: list[str] = []
    for feature in features:
        base = feature.partition(BINNED)[0]
        mark = next((m for m in RATIO_MARKS if m in base), None)
        raw.extend(base.split(mark, 1) if mark else [base])
    return unique(raw)


def kept_by(name: str, keep: Sequence[str]) -> bool:
    """A removed column comes back when it equals, or is part of, a name to keep."""
    return any(name in wanted for wanted in keep)


def _significant(value: float, precision: int) -> float:
    if value == 0 or not math.isfinite(value):
        return value
    fraction, whole = math.modf(value)
    digits = precision
    if whole == 0:
        digits += -int(math.floor(math.log10(abs(fraction)))) - 1
    return round(value, digits)


def right_closed_labels(edges: Sequence[float], precision: int = 3) -> list[str]:
    """Texts such as ``(-0.001, 0.2]`` for right-closed intervals whose first edge is included."""
    edges = [float(e) for e in edges]
    for digits in range(precision, 20):
        shown = [_significant(e, digits) for e in edges]
        if len(set(shown)) == len(set(edges)):
            break
    shown[0] -= 10.0**-digits
    shown[0] = round(shown[0], digits + 2)
    return [f"({lo}, {hi}]" for lo, hi in zip(shown, shown[1:])]


def left_closed_labels(splits: Sequence[float], digits: int = 2) -> list[str]:
    """Texts such as ``[1.50, 3.00)`` for the intervals that the splits cut the line into."""
    bounds = ["-inf", *(f"{s:.{digits}f}" for s in splits), "inf"]
    labels = [f"[{lo}, {hi})" for lo, hi in zip(bounds, bounds[1:])]
    labels[0] = "(" + labels[0][1:]
    return labels
