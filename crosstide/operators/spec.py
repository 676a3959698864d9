"""The registry of chain operators: kind, argument and look-back, in one place."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

CROSS, SERIES = "cross", "series"

#: Half-lives after which exp_decay is close enough to its steady state.
WARM_HALF_LIVES = 4


class SpecError(ValueError):
    """A declaration that cannot run."""


@dataclass(frozen=True)
class Operator:
    kind: str
    argument: str  # none, name, optional name, number, count
    history: Callable[[object], int] = lambda _: 0
    is_ref: bool = False


OPERATORS: dict[str, Operator] = {
    "rank": Operator(CROSS, "none"),
    "neutralize": Operator(CROSS, "name", is_ref=True),
    "truncate": Operator(CROSS, "number"),
    "scale": Operator(CROSS, "optional name"),
    "linear_decay": Operator(SERIES, "count", lambda n: int(n) - 1),
    "exp_decay": Operator(SERIES, "count", lambda h: WARM_HALF_LIVES * int(h)),
    "delay": Operator(SERIES, "count", lambda k: int(k)),
}


def history(ops: list[tuple[str, object]]) -> int:
    """Sessions of prior values that a chain needs: windows in a row add up."""
    return sum(OPERATORS[name].history(arg) for name, arg in ops)


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def check_argument(name: str, arg: object, where: str = "ops") -> None:
    """Raise SpecError for an unknown operator or an argument of the wrong type."""
    if name not in OPERATORS:
        raise SpecError(f"{where}: unknown operator {name!r}; known are {', '.join(sorted(OPERATORS))}")
    want = OPERATORS[name].argument
    good = {
        "none": arg is None,
        "name": isinstance(arg, str),
        "optional name": arg is None or isinstance(arg, str),
        "number": _number(arg),
        "count": isinstance(arg, int) and not isinstance(arg, bool) and arg > 0,
    }[want]
    if not good:
        raise SpecError(f"{where}: {name} takes {want if want != 'count' else 'a positive integer'} as its argument, not {arg!r} ({type(arg).__name__})")
    if name == "truncate" and arg <= 0:
        raise SpecError(f"{where}: truncate needs a share above 0, not {arg!r}")
    if name == "scale" and arg not in (None, "book"):
        raise SpecError(f"{where}: scale knows only 'book', not {arg!r}")


def check_covered(names: set[str], who: str) -> None:
    """An implementation proves on import that it has every operator and no other."""
    if names != set(OPERATORS):
        raise ImportError(f"{who}: missing {sorted(set(OPERATORS) - names)}, unknown {sorted(names - set(OPERATORS))}")
