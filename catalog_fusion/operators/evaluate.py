"""Train/test split, error metrics and median imputation."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_fusion.operators.number import number_rows

# Fixed values of the time split.
SPLIT_QUANTILE = 0.8
MIN_TRAIN = 200
MIN_TEST = 50
BY_YEAR, BY_POSITION = "year", "position"
# Edges that divide a range of values, and rows of a range that may be read, for medians.
_EDGES, _READ = 1000, 10_000


@dataclass(frozen=True)
class Split:
    train: DataFrame
    test: DataFrame
    method: str
    cutoff: float | None
    n_train: int
    n_test: int
    n_without_year: int


def year_cutoff(df: DataFrame) -> DataFrame:
    """The interpolated 0.8 quantile of ``year``, as one row.

    Exact and cheap: the state is one counter per distinct year.
    """
    return df.agg(F.percentile("year", SPLIT_QUANTILE).alias("cutoff"))


def label_by_year(df: DataFrame) -> DataFrame:
    """Add ``split``: ``train`` before the cutoff year, ``test`` from it on, else null."""
    cutoff = year_cutoff(df).scalar()
    return df.withColumn(
        "split", F.when(F.col("year") < cutoff, "train").when(F.col("year") >= cutoff, "test")
    )


def label_by_position(df: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``split``: the first 80 percent of the rows in ``order`` are ``train``."""
    numbered = number_rows(df, order, "_position")
    n_train = numbered.agg(F.floor(F.count(F.lit(1)) * F.lit(SPLIT_QUANTILE))).scalar()
    return numbered.withColumn(
        "split", F.when(F.col("_position") <= n_train, "train").otherwise("test")
    ).drop("_position")


def temporal_split(df: DataFrame, order: list[Column]) -> Split:
    """Older years train, newer ones test; by position where either side is too small."""
    cutoff = year_cutoff(df).first()["cutoff"]
    year = F.col("year")
    train, test = df.filter(year < cutoff), df.filter(year >= cutoff)
    counts = df.agg(
        F.count_if(year < cutoff).alias("train"),
        F.count_if(year >= cutoff).alias("test"),
        F.count_if(year.isNull()).alias("no_year"),
        F.count(F.lit(1)).alias("all"),
    ).first()
    if counts["train"] >= MIN_TRAIN and counts["test"] >= MIN_TEST:
        return Split(train, test, BY_YEAR, cutoff, counts["train"], counts["test"], counts["no_year"])
    labelled = label_by_position(df, order)
    n_train = int(counts["all"] * SPLIT_QUANTILE)
    return Split(
        labelled.filter(F.col("split") == "train").drop("split"),
        labelled.filter(F.col("split") == "test").drop("split"),
        BY_POSITION,
        None,
        n_train,
        counts["all"] - n_train,
        counts["no_year"],
    )


def clip_rating(prediction: Column) -> Column:
    """Predictions held within the rating scale, 1 to 10."""
    return F.least(F.greatest(prediction, F.lit(1.0)), F.lit(10.0))


def metric_columns(label: Column, prediction: Column) -> dict[str, Column]:
    """RMSE, MAE and R2, rounded to four digits, as aggregates of one pass."""
    y = label.cast("double")
    error = y - prediction.cast("double")
    spread = F.count(error) * F.var_pop(F.when(error.isNotNull(), y))
    return {
        "rmse": F.round(F.sqrt(F.avg(error * error)), 4),
        "mae": F.round(F.avg(F.abs(error)), 4),
        "r2": F.round(1 - F.try_divide(F.sum(error * error), spread), 4),
    }


def regression_metrics(df: DataFrame, label: str = "rating", prediction: str = "prediction") -> DataFrame:
    """The metrics of one prediction column, as one row."""
    metrics = metric_columns(F.col(label), F.col(prediction))
    return df.agg(*[value.alias(name) for name, value in metrics.items()])


@dataclass
class _Range:
    """Where a value of some rank lies: strictly between two values that are known, of ``held`` rows."""

    column: str
    rank: int  # within the range, from 0
    held: int
    low: float = -math.inf
    high: float = math.inf
    value: float | None = None

    def inside(self, values: dict[str, Column]) -> Column:
        v = values[self.column]
        whole = math.isinf(self.low) and math.isinf(self.high)
        return v if whole else F.when((v > self.low) & (v < self.high), v)


def _narrowed(df: DataFrame, ranges: list[_Range], values: dict[str, Column]) -> None:
    """Find each range's rank among edges from a sketch: it is an edge, or lies between two."""
    cells = {f"v{i}": r.inside(values) for i, r in enumerate(ranges)}
    part = df.select(*[v.alias(c) for c, v in cells.items()])
    shares = [i / _EDGES for i in range(_EDGES + 1)]
    found = part.agg(*[F.percentile_approx(c, shares, 10 * _EDGES).alias(c) for c in cells]).first()
    edges = {c: sorted(set(found[c])) for c in cells}
    splits = [[-math.inf, *([e for e in edges[c] if not math.isinf(e)] or [0.0]), math.inf] for c in cells]
    places = Bucketizer(splitsArray=splits, inputCols=list(cells), outputCols=[f"b_{c}" for c in cells], handleInvalid="keep").transform(part)
    held = []
    for i, c in enumerate(cells):
        at = F.col(f"b_{c}").cast("int")
        edge = F.coalesce(F.try_element_at(F.array(*[F.lit(e) for e in splits[i][:-1]]), at + 1) == F.col(c), F.lit(False))
        last = F.col(c) == math.inf  # the last bucket holds its upper end
        held.append(F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("range"), at.alias("bucket"), edge.alias("edge"), last.alias("last"))))
    counted = places.select(F.explode(F.array_compact(F.array(*held))).alias("p")).groupBy("p.range", "p.bucket", "p.edge", "p.last").count().collect()
    for i, r in enumerate(ranges):
        before = 0
        # In the order of values: each bucket's lower edge, what lies above it, infinity.
        for row in sorted((x for x in counted if x["range"] == i), key=lambda x: (x["last"], x["bucket"], not x["edge"])):
            if r.rank < before + row["count"]:
                low, high = splits[i][row["bucket"]], splits[i][row["bucket"] + 1]
                if row["edge"] or row["last"]:
                    r.value = math.inf if row["last"] else low
                else:
                    r.rank, r.held, r.low, r.high = r.rank - before, row["count"], max(r.low, low), min(r.high, high)
                break
            before += row["count"]


def _picked(df: DataFrame, ranges: list[_Range], values: dict[str, Column]) -> None:
    """Read the values of small ranges and pick each one's rank."""
    cells = [F.when(r.inside(values).isNotNull(), F.struct(F.lit(i).alias("range"), r.inside(values).alias("value"))) for i, r in enumerate(ranges)]
    counted = df.select(F.explode(F.array_compact(F.array(*cells))).alias("p")).groupBy("p.range", "p.value").count().collect()
    for i, r in enumerate(ranges):
        before = 0
        for row in sorted((x for x in counted if x["range"] == i), key=lambda x: x["value"]):
            before += row["count"]
            if r.rank < before:
                r.value = row["value"]
                break


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """The interpolated median of each column that has values. NaN counts as missing.

    Exact, by range selection: the middle ranks are narrowed to ranges between sketched
    edges, whose rows are counted, until a range is small enough to read. No task and no
    driver holds more than the edges or ``_READ`` values of a range.
    """
    values = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    counts = df.agg(*[F.count(v).alias(c) for c, v in values.items()]).first() if columns else None
    known = [c for c in columns if counts[c]]
    ranges = [_Range(c, rank, counts[c]) for c in known for rank in dict.fromkeys(((counts[c] - 1) // 2, counts[c] // 2))]
    while open_ranges := [r for r in ranges if r.value is None]:
        large = [r for r in open_ranges if r.held > _READ]
        if large:
            _narrowed(df, large, values)
        small = [r for r in open_ranges if r not in large]
        if small:
            _picked(df, small, values)
    middle = {c: [r.value for r in ranges if r.column == c] for c in known}
    return {c: sum(m) / len(m) for c, m in middle.items()}


def median_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and NaN of each column replaced by its median.

    A column without any value keeps its nulls.
    """
    filled = {c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(m)) for c, m in medians(df, columns).items()}
    return df.withColumns(filled) if filled else df
