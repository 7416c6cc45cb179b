"""Distinct counts and frequent values, decided by mergeable sketches and counted only where it is close.

A sketch per column is a few kilobytes that merge, so no value is shuffled to make one.
Most questions ("at most 20 values?", "almost unique?") are far from their bound; columns
near one are counted exactly, and so are numbers that are shown.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, functions as F

C = F.col
#: The distinct sketch has two to this power of cells, so a relative standard error of 0.4 per cent; within six of these
#: errors of a bound a column is counted.
CELLS, MARGIN = 16, 0.025
#: Estimates of few values may be off by so many.
FEW = 3
#: Values a frequency sketch tracks, and values asked of it beyond those wanted.
TRACKED, SPARE = 10_000, 30
MISSING = "Missing"


def long_values(data: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, value, records): one row per distinct value, null included."""
    text = data.select(*[C(name).cast("string").alias(name) for name in columns])
    return text.unpivot([], columns, "variable", "value").groupBy("variable", "value").agg(
        F.count(F.lit(1)).alias("records"))


def distinct_counts(data: DataFrame, columns: list[str]) -> dict[str, int]:
    """Exact distinct non-null values of every column from one grouped count."""
    counted = long_values(data, columns).groupBy("variable").agg(F.count("value").alias("n"))
    return {row["variable"]: row["n"] for row in counted.collect()}


class DistinctCounts(Mapping):
    """Distinct values per column: exact when looked up, estimated where that decides a question.

    With ``approximate`` every answer is the estimate.
    """

    def __init__(self, data: DataFrame, approximate: bool = False):
        self.data, self.approximate = data, approximate
        self._exact: dict[str, int] = {}
        self._estimates: dict[str, int] | None = None

    def __iter__(self):
        return iter(self.data.columns)

    def __len__(self) -> int:
        return len(self.data.columns)

    @property
    def estimates(self) -> dict[str, int]:
        if self._estimates is None:
            row = self.data.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(C(n).cast("string"), F.lit(CELLS))).alias(f"e{k}") for k, n in enumerate(self.data.columns)]).first()
            self._estimates = {n: row[f"e{k}"] for k, n in enumerate(self.data.columns)}
        return self._estimates

    def settle(self, names: Iterable[str]) -> None:
        """Count these columns exactly, in one job."""
        fresh = [n for n in dict.fromkeys(names) if n not in self._exact]
        if fresh and self.approximate:
            self._exact.update({n: self.estimates[n] for n in fresh})
        elif fresh:
            self._exact.update(dict.fromkeys(fresh, 0) | distinct_counts(self.data, fresh))

    def __getitem__(self, name: str) -> int:
        if name not in self.data.columns:
            raise KeyError(name)
        self.settle([name])
        return self._exact[name]

    def close(self, name: str, bound: float) -> bool:
        """Whether the estimate leaves open on which side of the bound the column is."""
        return name not in self._exact and abs(self.estimates[name] - bound) <= MARGIN * bound + FEW

    def decided(self, names: Iterable[str], *bounds: float) -> dict[str, int]:
        """Counts that are on the right side of every bound: exact for columns near one, estimates for the rest."""
        names = list(names)
        self.settle([n for n in names if any(self.close(n, bound) for bound in bounds)])
        return {n: self._exact[n] if n in self._exact else self.estimates[n] for n in names}

    def ordered(self, names: Iterable[str]) -> dict[str, int]:
        """Counts that sort as the exact ones do: columns whose estimates are near another's are counted."""
        ranked = sorted((n for n in names), key=lambda n: self.decided([n])[n])
        found = self.decided(ranked)
        near = [pair for pair in zip(ranked, ranked[1:]) if found[pair[1]] - found[pair[0]] <= 2 * (MARGIN * found[pair[1]] + FEW)]
        self.settle([n for pair in near for n in pair])
        return self.decided(ranked)


def frequent_values(data: DataFrame, columns: list[str], most: int, rows: int, tracked: int = TRACKED) -> tuple[dict[str, list[tuple[str, int]]], list[str]]:
    """The ``most`` commonest values of columns, null as "Missing", exact; and the columns that must be counted whole.

    One aggregate finds candidates, one more counts them. A value outside the candidates has
    at most the count of the last one, or the sketch's error; if the last wanted count is
    above both, nothing was missed. Equal counts go by value.
    """
    if not columns:
        return {}, []
    shown = {n: F.coalesce(C(n).cast("string"), F.lit(MISSING)) for n in columns}
    texts = data.select(*[value.alias(f"t{k}") for k, value in enumerate(shown.values())])
    wide = texts.agg(*[F.expr(f"approx_top_k(t{k}, {most + SPARE}, {max(tracked, most + SPARE)})").alias(f"t{k}") for k in range(len(columns))]).first()
    settled, open_columns = {}, {}
    for k, name in enumerate(columns):
        candidates = [(r["item"], r["count"]) for r in wide[f"t{k}"]]
        if sum(n for _, n in candidates) == rows:  # all values, and their counts
            settled[name] = candidates
        elif len(candidates) >= most:
            open_columns[k] = candidates
    if open_columns:
        cells = [F.struct(F.lit(k).alias("k"), C(f"t{k}").alias("v")) for k in open_columns]
        wanted = F.coalesce(*[F.when(C("r.k") == k, C("r.v").isin([v for v, _ in found])) for k, found in open_columns.items()])
        counted = texts.select(F.explode(F.array(*cells)).alias("r")).where(wanted).groupBy("r.k", "r.v").agg(F.count(F.lit(1)).alias("n")).collect()
        for k, candidates in open_columns.items():
            exact = sorted(((r["v"], r["n"]) for r in counted if r["k"] == k), key=lambda x: (-x[1], x[0]))
            beyond = max(candidates[-1][1], 2.625 * rows / tracked)  # the map of the sketch is at least a third larger than ``tracked``
            if len(exact) >= most and exact[most - 1][1] > beyond:
                settled[columns[k]] = exact
    top = {name: sorted(found, key=lambda x: (-x[1], x[0]))[:most] for name, found in settled.items()}
    return top, [n for n in columns if n not in top]
