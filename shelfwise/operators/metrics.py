"""Metric views: dimensions and measures as data, grouped at the grain a question asks for."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MetricView:
    """A relation with named dimensions (row expressions) and measures (aggregates), both SQL text.

    `source` gets the columns a query needs and returns a frame with at least those, so a view over joined tables
    joins only what is asked for. Ratios are measures, hence always computed at the queried grain.
    """

    source: Callable[[Sequence[str]], DataFrame]
    columns: Sequence[str]
    dimensions: Mapping[str, str]
    measures: Mapping[str, str]
    #: Optional first step for rows that lie by some columns already: `parts` are aggregates by the dimensions and `lies_by`, which
    #: needs no shuffle, and measures aggregate the parts.
    lies_by: Sequence[str] = ()
    parts: Mapping[str, str] = field(default_factory=dict)

    def _needed(self, texts: Sequence[str]) -> list[str]:
        words = set(re.findall(r"\w+", " ".join(texts)))
        return [c for c in self.columns if c in words]

    def query(
        self,
        dimensions: Sequence[str] = (),
        measures: Sequence[str] = (),
        where: Sequence[str | tuple[str, Callable[[Column], Column]]] = (),
    ) -> DataFrame:
        """Measures by dimensions. `where` holds SQL conditions, or (expression, test) pairs where the test takes the
        expression as a Column, for bounds that only a query knows."""
        rows, keys = self._rows(dimensions, measures, where), self._keys(dimensions)
        if self.parts:
            parts = [F.expr(text).alias(name) for name, text in self._parts(measures).items()]
            rows, keys = rows.groupBy(*keys, *self.lies_by).agg(*parts), list(dimensions)
        return rows.groupBy(*keys).agg(*[F.expr(self.measures[m]).alias(m) for m in measures])

    def rollup(
        self,
        dimensions: Sequence[str],
        measures: Sequence[str],
        where: Sequence[str | tuple[str, Callable[[Column], Column]]] = (),
    ) -> DataFrame:
        """Measures at every level of a hierarchy, widest last dimension first, in one pass: all dimensions, all but the last,
        and so on to the whole. `level` counts the dimensions that are summed over, so a NULL key of a level and a NULL value
        are told apart. Ratios are worked out anew at each level."""
        rows = self._rows(dimensions, measures, where)
        if self.parts:
            rows = rows.withColumns({d: F.expr(self.dimensions[d]) for d in dimensions})
            levels = [[*dimensions[:kept], *self.lies_by] for kept in range(len(dimensions), -1, -1)]
            parts = [F.expr(text).alias(name) for name, text in self._parts(measures).items()]
            stepped = rows.groupingSets([[F.col(c) for c in one] for one in levels], *dimensions, *self.lies_by)
            stepped = stepped.agg(F.bit_count(F.grouping_id()).alias("level"), *parts)
            return stepped.groupBy(*dimensions, "level").agg(*[F.expr(self.measures[m]).alias(m) for m in measures])
        grouped = rows.rollup(*self._keys(dimensions))
        # The grouping id has one bit for each dimension that is summed over; in a rollup these are the last ones.
        return grouped.agg(
            F.bit_count(F.grouping_id()).alias("level"), *[F.expr(self.measures[m]).alias(m) for m in measures]
        )

    def _parts(self, measures: Sequence[str]) -> dict[str, str]:
        words = set(re.findall(r"\w+", " ".join(self.measures[m] for m in measures)))
        return {name: text for name, text in self.parts.items() if name in words}

    def _keys(self, dimensions: Sequence[str]) -> list[Column]:
        return [F.expr(self.dimensions[d]).alias(d) for d in dimensions]

    def _rows(self, dimensions: Sequence[str], measures: Sequence[str], where: Sequence) -> DataFrame:
        texts = [self.dimensions[d] for d in dimensions] + [self.measures[m] for m in measures]
        texts += [*self._parts(measures).values(), *self.lies_by]
        texts += [w if isinstance(w, str) else w[0] for w in where]
        df = self.source(self._needed(texts))
        for w in where:
            df = df.filter(F.expr(w) if isinstance(w, str) else w[1](F.expr(w[0])))
        return df
