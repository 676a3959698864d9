"""Chains of operators compiled to one plan: gate, operators in order, gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.operators import cross_section as cs
from crosstide.operators import time_series as ts
from crosstide.operators.spec import OPERATORS, SERIES, check_argument, check_covered, history


class Chain:
    """ops: [(name, argument)]. apply() adds the operators to a dense panel (di, ii, x, ...).

    Adjacent operators over the same key share one exchange; each change between
    sessions and securities costs one. State of the series operators starts empty
    at the panel's first session, and an operator may occur more than once.
    """

    def __init__(self, ops: list[tuple[str, object]]):
        for name, arg in ops or []:
            check_argument(name, arg)
        self.ops = list(ops or [])

    @property
    def history(self) -> int:
        return history(self.ops)

    @property
    def needs_groups(self) -> set[str]:
        return {str(arg) for name, arg in self.ops if name == "neutralize"}

    def apply(self, df: DataFrame, x: str, pool: str | None = None, groups: dict[str, str] | None = None, first: int = 0, last: int = 0) -> tuple[DataFrame, list[str]]:
        """The panel with x replaced, and the names of columns that flag sessions without a book.

        groups maps neutralize's references to columns; without it the argument is a column.
        first and last bound the panel's sessions.
        """
        df = df.withColumn(x, cs.in_pool_only(x, pool).cast("double"))
        flags: list[str] = []
        for i, (name, arg) in enumerate(self.ops):
            if OPERATORS[name].kind == SERIES:
                df = _SERIES[name](df, x, arg, first, last)
            elif name == "neutralize":
                df = cs.neutralize(df, x, (groups or {}).get(str(arg), str(arg)))
            elif name == "scale":
                flags.append(f"_empty_{i}")
                df = cs.scale(df, x, pool, degenerate=flags[-1])
            else:
                df = _CROSS[name](df, x, arg)
        return df, flags

    def __repr__(self) -> str:
        return f"Chain({', '.join(n if a is None else f'{n}:{a}' for n, a in self.ops)})"


_SERIES = {
    "linear_decay": lambda df, x, n, first, last: df.withColumn(x, ts.linear_decay(x, n)),
    "exp_decay": lambda df, x, h, first, last: ts.exp_decay(df, x, h),
    "delay": lambda df, x, k, first, last: df.withColumn(x, ts.delay(x, k)),
}
_CROSS = {"rank": lambda df, x, _: cs.rank(df, x), "truncate": lambda df, x, share: cs.truncate(df, x, float(share))}

check_covered({*_SERIES, *_CROSS, "neutralize", "scale"}, __name__)


def weights(df: DataFrame, x: str, ops: list[tuple[str, object]], pool: str | None = None, first: int = 0, last: int = 0) -> DataFrame:
    """A panel's chain without the flags."""
    out, flags = Chain(ops).apply(df, x, pool, first=first, last=last)
    return out.drop(*flags)


def empty_sessions(df: DataFrame, flags: list[str]) -> DataFrame:
    """Sessions on which a scale had no book: (di)."""
    if not flags:
        return df.select("di").limit(0)
    any_flag = flags[0] if len(flags) == 1 else None
    condition = F.col(any_flag) if any_flag else F.greatest(*[F.col(f) for f in flags])
    return df.where(condition).select("di").distinct()
