"""Names of variables, built where the plan is made."""

from __future__ import annotations

import math
from collections.abc import Sequence

# Variable names of the distances, by layer.
DISTANCE = {
    "airport": "D_Airport",
    "bus_stop": "D_Bus",
    "coastline": "D_Coast",
    "mdl": "D_North",
    "ports": "D_Port",
    "railstation": "D_Rail",
    "river": "D_River",
    "roads": "D_Road",
    "mr1": "D_MR1",
    "mr2": "D_MR2",
}
# Letter of an elevation layer in variable names.
ELEVATION = {"dem": "k", "dsm": "a"}


def padded(size: float) -> str:
    """A buffer size as a whole number of at least four digits, halves rounded up."""
    return f"{math.floor(size + 0.5):04d}"


def plain(sizes: Sequence[float]) -> dict[float, str]:
    """Buffer sizes as decimals; if one has a fraction or is a float, all show as many digits."""
    digits = max((len(repr(float(s)).partition(".")[2]) for s in sizes if isinstance(s, float)), default=0)
    return {float(s): f"{s:.{digits}f}" if digits else str(int(s)) for s in sizes}


def checked_sizes(sizes: float | Sequence[float] | None, rounded: bool = True) -> list[float]:
    """Buffer sizes, sorted and once each; a single number is a list of one, and none at all is size 0.

    Sizes that names show as the same whole number raise if names are ``rounded``.
    """
    if sizes is None:
        sizes = [0]
    out = list({float(s): s for s in reversed(sorted([sizes] if isinstance(sizes, (int, float)) else list(sizes)))}.values())[::-1]
    if rounded and len({padded(s) for s in out}) != len(out):
        raise ValueError(f"Buffer sizes {out} round to the same name")
    return out


def checked(values, valid: Sequence, what: str) -> list:
    """Values, sorted; a single one is a list of one; unknown ones raise."""
    out = sorted([values] if isinstance(values, (int, str)) else list(values))
    for v in out:
        if v not in valid:
            raise ValueError(f"Invalid {what} '{v}'. Valid {what}s are: {list(valid)}")
    return out
