"""What a handle sees: columns of a plan (Ctx), or one session's arrays (DayCtx).

A handle is written once: ``ctx.f(ref)`` is today's cross-section, ``ctx.win(ref, w)``
the last w sessions. With Ctx these are expressions, and a node becomes a plan.
DayCtx runs handles that need arbitrary Python, session by session, in one task.
Neither takes a date or reaches forward, so a handle cannot look ahead.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.scalar import safe_div
from crosstide.operators import cross_section as cs
from crosstide.operators import time_series as ts


def _undeclared(node, ref: str, declared) -> KeyError:
    return KeyError(f"{node.name}: {ref} is not in deps; declared: {', '.join(sorted(declared)) or 'nothing'}")


def check_outputs(node, given: dict) -> None:
    """multi_outputs gets exactly the declared outputs, of which there are several."""
    if len(node.outputs) < 2:
        raise ValueError(f"{node.name} has one output: return it as it is")
    for k in sorted(set(given) - set(node.outputs)):
        near = difflib.get_close_matches(k, list(node.outputs), 1)
        raise ValueError(f"{node.name}: output {k!r} is not declared" + (f"; did you mean {near[0]!r}?" if near else ""))
    if missing := sorted(set(node.outputs) - set(given)):
        raise ValueError(f"{node.name}: outputs {missing} are missing; pass missing values rather than no value")


class Value:
    """A number per security and session (or per session), as an expression."""

    __array_ufunc__ = None  # numpy numbers on the left leave the operation to this class
    __hash__ = None

    def __init__(self, ctx: Ctx, column: Column):
        self.ctx, self.column = ctx, column

    def _with(self, other, f: Callable[[Column, Column], Column], swap: bool = False):
        if isinstance(other, Lookback):
            return NotImplemented
        x, y = self.column, _column(other)
        return Value(self.ctx, f(y, x) if swap else f(x, y))

    def __add__(self, o):
        return self._with(o, lambda a, b: a + b)

    def __radd__(self, o):
        return self._with(o, lambda a, b: a + b, True)

    def __sub__(self, o):
        return self._with(o, lambda a, b: a - b)

    def __rsub__(self, o):
        return self._with(o, lambda a, b: a - b, True)

    def __mul__(self, o):
        return self._with(o, lambda a, b: a * b)

    def __rmul__(self, o):
        return self._with(o, lambda a, b: a * b, True)

    def __truediv__(self, o):
        return self._with(o, safe_div)

    def __rtruediv__(self, o):
        return self._with(o, safe_div, True)

    def __pow__(self, o):
        return self._with(o, F.pow)

    def __neg__(self):
        return Value(self.ctx, -self.column)

    def __gt__(self, o):
        return self._with(o, lambda a, b: a > b)

    def __ge__(self, o):
        return self._with(o, lambda a, b: a >= b)

    def __lt__(self, o):
        return self._with(o, lambda a, b: a < b)

    def __le__(self, o):
        return self._with(o, lambda a, b: a <= b)

    def __and__(self, o):
        return self._with(o, lambda a, b: a & b)

    def __or__(self, o):
        return self._with(o, lambda a, b: a | b)

    def __invert__(self):
        return Value(self.ctx, ~self.column)

    def abs(self):
        return Value(self.ctx, F.abs(self.column))

    __abs__ = abs

    def map(self, f: Callable[[Column], Column]):
        """Any function of columns."""
        return Value(self.ctx, f(self.column))

    def log(self):
        return Value(self.ctx, F.when(self.column > 0, F.log(self.column)))

    def sqrt(self):
        return Value(self.ctx, F.when(self.column >= 0, F.sqrt(self.column)))

    def clip(self, low: float, high: float):
        return Value(self.ctx, F.when(self.column.isNotNull(), F.greatest(F.lit(low), F.least(self.column, F.lit(high)))))

    def fillna(self, x):
        return Value(self.ctx, F.coalesce(self.column, _column(x)))

    def where(self, condition: Value, other=None):
        return Value(self.ctx, F.when(condition.column, self.column).otherwise(_column(other)))

    def isna(self):
        return Value(self.ctx, self.column.isNull())

    def _across(self, f: Callable[[Column], Column]):
        kept = self.ctx._keep(self.column)
        return Value(self.ctx, self.ctx._keep(f(kept).over(Window.partitionBy("di"))))

    def mean(self):
        return self._across(F.avg)

    def sum(self):
        return self._across(F.sum)

    def std(self):
        return self._across(F.stddev_samp)

    def min(self):
        return self._across(F.min)

    def max(self):
        return self._across(F.max)

    def count(self):
        return self._across(F.count)


def _column(x) -> Column:
    if isinstance(x, Value):
        return x.column
    if isinstance(x, Column):
        return x
    if x is None or isinstance(x, float) and math.isnan(x):
        return F.lit(None).cast("double")
    return F.lit(x.item() if isinstance(x, np.generic) else x)


class Lookback:
    """The last w sessions of an expression; reducing it along sessions gives a Value."""

    __array_ufunc__ = None
    __hash__ = None

    def __init__(self, ctx: Ctx, column: Column, w: int):
        if w < 1:
            raise ValueError("a window has at least one session")
        self.ctx, self.column, self.w = ctx, column, w
        self.loc = _Row(self)

    def _with(self, other, f, swap=False):
        if isinstance(other, Lookback):
            if other.w != self.w:
                raise ValueError(f"windows of {self.w} and {other.w} sessions do not match")
            y = other.column
        elif isinstance(other, Value):
            raise ValueError("a window and a cross-section do not mix: reduce the window first")
        else:
            y = _column(other)
        return Lookback(self.ctx, f(y, self.column) if swap else f(self.column, y), self.w)

    __add__, __radd__, __sub__, __rsub__ = Value.__add__, Value.__radd__, Value.__sub__, Value.__rsub__
    __mul__, __rmul__, __truediv__, __rtruediv__, __pow__ = Value.__mul__, Value.__rmul__, Value.__truediv__, Value.__rtruediv__, Value.__pow__
    __gt__, __ge__, __lt__, __le__ = Value.__gt__, Value.__ge__, Value.__lt__, Value.__le__

    def __neg__(self):
        return Lookback(self.ctx, -self.column, self.w)

    def abs(self):
        return Lookback(self.ctx, F.abs(self.column), self.w)

    def _reduce(self, f: Callable[[Column], Column]):
        kept = self.ctx._keep(self.column)
        return self.ctx._pooled(self.ctx._keep(f(kept).over(ts.last_sessions(self.w))))

    def mean(self):
        return self._reduce(F.avg)

    def sum(self):
        return self._reduce(lambda c: F.coalesce(F.sum(c), F.lit(0.0)))

    def std(self):
        return self._reduce(F.stddev_samp)

    def var(self):
        return self._reduce(F.var_samp)

    def min(self):
        return self._reduce(F.min)

    def max(self):
        return self._reduce(F.max)

    def count(self):
        return self._reduce(F.count)

    def median(self):
        return self.ctx._pooled(self.ctx._keep(ts.median(self.ctx._keep(self.column), self.w)))

    def corr(self, other: Lookback):
        a, b = self.ctx._keep(self.column), self.ctx._keep(other.column)
        return self.ctx._pooled(self.ctx._keep(F.corr(a, b).over(ts.last_sessions(self.w))))


class _Row:
    def __init__(self, window: Lookback):
        self.window = window

    def __getitem__(self, k: int) -> Value:
        w = self.window
        if not -w.w < k <= 0:
            raise IndexError(f"the window holds -{w.w - 1}..0, not {k}: nothing lies ahead")
        kept = w.ctx._keep(w.column)
        return w.ctx._pooled(kept if k == 0 else w.ctx._keep(ts.delay(kept, -k)))


class _Tools:
    """Statistics across a session's securities."""

    def __init__(self, ctx: Ctx):
        self.ctx = ctx

    def _apply(self, x: Value, f) -> Value:
        name = self.ctx._keep_name(x.column)
        self.ctx.frame = f(self.ctx.frame, name)
        return Value(self.ctx, F.col(name))

    def rank(self, x: Value) -> Value:
        return self._apply(x, cs.rank)

    def zscore(self, x: Value) -> Value:
        return self._apply(x, cs.zscore)

    def demean(self, x: Value, by: Value | None = None) -> Value:
        if by is None:
            return self._apply(x, cs.demean)
        group = self.ctx._keep_name(by.column)
        return self._apply(x, lambda df, name: cs.neutralize(df, name, group))


class Ctx:
    """Builds a node's plan on the dense frame (di, date, ii, in_pool, one column per dependency)."""

    def __init__(self, frame: DataFrame, node, columns: dict[str, str], ranks: dict[str, int], securities: list[int], has_pool: bool):
        self.frame, self.node, self._columns, self._ranks = frame, node, columns, ranks
        self.params, self.cols, self.cs, self._has_pool = dict(node.params), securities, _Tools(self), has_pool
        self._open, self._n = False, 0

    def _keep_name(self, column: Column) -> str:
        self._n += 1
        name = f"_x{self._n}"
        self.frame = self.frame.withColumn(name, column)
        return name

    def _keep(self, column: Column) -> Column:
        """The expression as a column of the frame: windows do not nest."""
        return F.col(self._keep_name(column))

    def _pooled(self, column: Column) -> Value:
        """Today's membership masks a whole window, whatever was inside before."""
        return Value(self, F.when(F.col("in_pool"), column) if self._has_pool else column)

    def _require(self) -> None:
        if not self._open:
            raise RuntimeError("data are there in handle only, not in init")

    def _source(self, ref: str) -> Column:
        self._require()
        if ref not in self._columns:
            raise _undeclared(self.node, ref, self._columns)
        return F.col(self._columns[ref])

    def f(self, ref: str) -> Value:
        column = self._source(ref)
        return Value(self, column) if self._ranks[ref] == 1 else self._pooled(column)

    def win(self, ref: str, w: int) -> Lookback:
        column = self._source(ref)
        if self._ranks[ref] == 3:
            raise ValueError(f"{ref} has three dims: reduce its arrays with f(ref).map(...) first")
        return Lookback(self, column, int(w))

    def today(self) -> Value:
        self._require()
        return Value(self, F.col("date"))

    @property
    def t(self) -> Value:
        return Value(self, F.col("di"))

    @property
    def universe(self) -> Value:
        return Value(self, F.col("in_pool"))

    def multi_outputs(self, **given):
        check_outputs(self.node, given)
        return given


class DayCtx:
    """One session at a time over arrays: for handles with state, recursion or libraries of their own."""

    class _Cross:
        @staticmethod
        def rank(x: pd.Series) -> pd.Series:
            seen = x.count()
            return x * 0.0 if seen <= 1 else (x.rank() - 1) / (seen - 1) - 0.5

        @staticmethod
        def zscore(x: pd.Series) -> pd.Series:
            spread = x.std()
            return (x - x.mean()) / spread if spread > 0 else x * 0.0

        @staticmethod
        def demean(x: pd.Series, by: pd.Series | None = None) -> pd.Series:
            return x - (x.mean() if by is None else x.groupby(by, dropna=False).transform("mean"))

    def __init__(self, node, days: list[int], dates: list[str], names: list[int], panels: dict[str, np.ndarray], pool: np.ndarray | None):
        self.node, self.params, self.cols, self.state, self.cs = node, dict(node.params), pd.Index(names), {}, DayCtx._Cross()
        self._days, self._dates, self._panels, self._pool = days, dates, panels, pool
        self._at: int | None = None

    def _require(self) -> int:
        if self._at is None:
            raise RuntimeError("data are there in handle only, not in init")
        return self._at

    @property
    def t(self) -> int:
        return self._days[self._require()]

    def today(self) -> str:
        return self._dates[self._require()]

    @property
    def universe(self) -> pd.Series:
        at = self._require()
        return pd.Series(True if self._pool is None else self._pool[at], index=self.cols)

    def _panel(self, ref: str) -> np.ndarray:
        if ref not in self._panels:
            raise _undeclared(self.node, ref, self._panels)
        return self._panels[ref]

    def f(self, ref: str):
        row = self._panel(ref)[self._require()]
        if row.ndim == 0:
            return float(row)
        if row.ndim == 2:
            return pd.DataFrame(row, index=self.cols)
        out = pd.Series(row, index=self.cols, dtype=float)
        return out if self._pool is None else out.where(self._pool[self._at])

    def win(self, ref: str, w: int):
        at, panel = self._require(), self._panel(ref)
        rows = np.full((w, *panel.shape[1:]), np.nan)
        have = panel[max(0, at - w + 1) : at + 1]
        rows[w - len(have) :] = have
        places = range(1 - w, 1)
        if rows.ndim == 1:
            return pd.Series(rows, index=places)
        if rows.ndim == 3:
            return rows
        if self._pool is not None:
            rows[:, ~self._pool[at]] = np.nan
        return pd.DataFrame(rows, index=places, columns=self.cols)

    def multi_outputs(self, **given):
        check_outputs(self.node, given)
        return given
