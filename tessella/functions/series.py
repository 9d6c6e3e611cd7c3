"""Series kernels as window expressions: windows count valid observations, warm-up gives null.

Drop null inputs before using them; a kernel over w needs w valid values.
Deviations are of the population; a z-score is 0 where the deviation is below 1e-12.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

TINY = 1e-12


class Series:
    """Kernels over one order: Series(Window.partitionBy(series).orderBy(ts, id))."""

    def __init__(self, window: WindowSpec):
        self.window = window

    def _full(self, value: Column, w: int) -> Column:
        return F.when(F.count(F.lit(1)).over(self.last(w)) == w, value)

    def last(self, w: int) -> WindowSpec:
        return self.window.rowsBetween(1 - w, 0)

    def lag(self, x: Column, k: int = 1) -> Column:
        return F.lag(x, k).over(self.window)

    def diff(self, x: Column, k: int = 1) -> Column:
        return x - self.lag(x, k)

    def ret(self, x: Column, k: int = 1) -> Column:
        return F.try_divide(x, self.lag(x, k)) - 1

    def logret(self, x: Column, k: int = 1) -> Column:
        before = self.lag(x, k)
        return F.when((x > 0) & (before > 0), F.log(x / before))

    def rmean(self, x: Column, w: int) -> Column:
        return self._full(F.avg(x).over(self.last(w)), w)

    def rsum(self, x: Column, w: int) -> Column:
        return self._full(F.sum(x).over(self.last(w)), w)

    def rstd(self, x: Column, w: int) -> Column:
        return self._full(F.stddev_pop(x).over(self.last(w)), w)

    def rmin(self, x: Column, w: int) -> Column:
        return self._full(F.min(x).over(self.last(w)), w)

    def rmax(self, x: Column, w: int) -> Column:
        return self._full(F.max(x).over(self.last(w)), w)

    def rrank(self, x: Column, w: int) -> Column:
        """Average rank of the newest value, from 1."""
        held = F.collect_list(x).over(self.last(w))
        below, ties = F.size(F.filter(held, lambda v: v < x)), F.size(F.filter(held, lambda v: v == x))
        return self._full(below + (ties + 1) / 2, w)

    def zscore(self, x: Column, w: int) -> Column:
        sd = F.stddev_pop(x).over(self.last(w))
        return self._full(F.when(sd <= TINY, F.lit(0.0)).otherwise((x - F.avg(x).over(self.last(w))) / sd), w)

    def rcorr(self, x: Column, y: Column, w: int) -> Column:
        sx, sy = F.stddev_pop(x).over(self.last(w)), F.stddev_pop(y).over(self.last(w))
        return self._full(F.when((sx > TINY) & (sy > TINY), F.try_divide(F.covar_pop(x, y).over(self.last(w)), sx * sy)), w)

    def wsum(self, x: Column, y: Column, w: int) -> Column:
        return self._full(F.sum(x * y).over(self.last(w)), w)

    def ewma(self, x: Column, span: float) -> Column:
        """y0 = x0, then alpha = 2 / (span + 1), exact to the last bits of a double: values that weigh less than 1e-17 of the whole are left out."""
        return self._smoothed(x, 2 / (span + 1))

    def ewma_halflife(self, x: Column, h: float) -> Column:
        return self._smoothed(x, 1 - 2 ** (-1 / h))

    def _smoothed(self, x: Column, alpha: float) -> Column:
        reach = 2 if alpha >= 1 else math.ceil(math.log(1e-17) / math.log1p(-alpha)) + 1
        held = F.collect_list(x).over(self.last(reach))
        return F.aggregate(F.slice(held, 2, reach), F.element_at(held, 1), lambda y, v: F.lit(alpha) * v + F.lit(1 - alpha) * y)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def indicator(test: Column) -> Column:
    return F.when(test, 1.0).when(~test, 0.0)


def ratio(x: Column, y: Column) -> Column:
    return F.try_divide(x, y)
