"""Smoothed target means per key, and their lookup."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_fusion.scratch import materialize

SMOOTHING = 18.0  # fixed value: weight of the global mean, in rows

# Lookup tables of at most this size together, as counted, are sent to every task.
BROADCAST_BYTES = 32 * 1024 * 1024
_ROW_BYTES = 32  # numbers and row overhead beside the key
# Frequent keys of a column that the large lookup answers by broadcast, and keys its sketch tracks.
HOT_KEYS, _TRACKED = 256, 4096
_SHORT_KEY, _DIGEST = 32, 64  # bytes


def _key(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def target_stats(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Row count and mean target per ``(column, key)``, in one aggregate.

    Every task combines its rows first, so frequent keys shuffle as one row.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _key(c).alias("key")) for c in columns]))
    keyed = df.select(F.col(target).cast("double").alias("y"), pairs.alias("pair"))
    return keyed.groupBy("pair.column", "pair.key").agg(
        F.count("y").alias("n"), F.avg("y").alias("mean")
    )


def smoothed(n: Column, mean: Column, overall: Column, smoothing: float = SMOOTHING) -> Column:
    """Mean pulled toward the overall mean by ``smoothing`` rows."""
    own = F.coalesce(n * mean, F.lit(0.0))
    return (own + F.lit(smoothing) * overall) / (n + F.lit(smoothing))


def target_encoding(
    df: DataFrame, columns: Sequence[str], target: str, smoothing: float = SMOOTHING
) -> DataFrame:
    """``(column, key, n, encoded)`` as one lazy query; the overall mean is a scalar subquery."""
    overall = df.agg(F.avg(F.col(target).cast("double"))).scalar()
    stats = target_stats(df, columns, target)
    return stats.select("column", "key", "n", smoothed(F.col("n"), F.col("mean"), overall, smoothing).alias("encoded"))


@dataclass(frozen=True)
class TargetEncoder:
    """A fitted encoding: its table, the default for unseen keys, bytes per column, and in all with narrow keys."""

    table: DataFrame
    default: float
    sizes: dict[str, int]
    narrow_size: int

    @classmethod
    def fit(
        cls, df: DataFrame, columns: Sequence[str], target: str, smoothing: float = SMOOTHING
    ) -> TargetEncoder:
        default = df.agg(F.avg(F.col(target).cast("double"))).first()[0]
        stats = target_stats(df, columns, target)
        table = stats.select(
            "column", "key", "n", smoothed(F.col("n"), F.col("mean"), F.lit(default), smoothing).alias("encoded")
        )
        return cls.of(materialize(table, "encoder"), default, columns)

    @classmethod
    def of(cls, table: DataFrame, default: float, columns: Sequence[str]) -> TargetEncoder:
        """An encoder over a stored table; its counted size per column decides the join."""
        size = F.sum(F.octet_length("key") + F.lit(_ROW_BYTES))
        narrow = F.sum(F.when(F.octet_length("key") <= _SHORT_KEY, F.octet_length("key")).otherwise(_DIGEST) + F.lit(1 + _ROW_BYTES))
        counted = {r["column"]: r for r in table.groupBy("column").agg(size.alias("size"), narrow.alias("narrow")).collect()}
        sizes = {c: counted[c]["size"] if c in counted else 0 for c in columns}
        return cls(table, default, sizes, sum(counted[c]["narrow"] for c in columns if c in counted))

    def transform(self, df: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """Add ``<column>_enc``: the encoded key, or the default for an unseen one.

        Up to ``broadcast_bytes`` the tables are broadcast, with long keys by their SHA-256
        if only so they fit; beyond, only frequent keys are, and the others of all columns
        are looked up by one shuffled join. The result is the same.
        """
        whole = sum(self.sizes.values()) <= broadcast_bytes
        if whole or self.narrow_size <= broadcast_bytes:
            form = (lambda key: key) if whole else _narrow
            for column in self.sizes:
                lookup = self.table.filter(F.col("column") == column).select(
                    form(F.col("key")).alias("_key"), F.col("encoded").alias("_encoded")
                )
                found = df.join(F.broadcast(lookup), form(_key(column)) == F.col("_key"), "left")
                df = found.withColumn(f"{column}_enc", self._or_default("_encoded")).drop("_key", "_encoded")
            return df
        return self._large_lookup(df)

    def _or_default(self, value: str) -> Column:
        return F.coalesce(F.col(value), F.lit(self.default)).cast("float")

    def _large_lookup(self, df: DataFrame) -> DataFrame:
        """All columns by one shuffled join of narrow rows.

        The most frequent keys of the rows, told by a sketch, are answered by a broadcast of
        at most ``HOT_KEYS`` for each column, so no key fills a task of the join. All other
        keys become narrow rows, which are looked up and gathered by row; rows themselves
        move once. They are numbered in a written table, so that a task that runs again
        gives them the same numbers.
        """
        columns = list(self.sizes)
        keys = {c: f"_key{i}" for i, c in enumerate(columns)}
        numbered = df.select("*", *[_narrow(_key(c)).alias(k) for c, k in keys.items()])
        numbered = materialize(numbered.withColumn("_row", F.monotonically_increasing_id()), "encode")
        table = self.table.select("column", _narrow(F.col("key")).alias("_narrow"), "encoded")
        hot = hot_hashes(numbered, list(keys.values()))
        found = numbered
        for c, k in keys.items():
            few = table.where((F.col("column") == c) & F.xxhash64("_narrow").isin(hot[k]))
            found = found.join(F.broadcast(few.select(F.col("_narrow").alias(k), F.col("encoded").alias(f"_hot{k}"))), k, "left")
        cold = cold_probes(numbered, keys, hot).join(table, ["column", "_narrow"])
        cold = cold.groupBy("_row").agg(*[F.max(F.when(F.col("column") == c, F.col("encoded"))).alias(f"_cold{k}") for c, k in keys.items()])
        joined = found.join(cold, "_row", "left")
        encoded = [F.coalesce(f"_hot{k}", f"_cold{k}", F.lit(self.default)).cast("float").alias(f"{c}_enc") for c, k in keys.items()]
        return joined.select(*[F.col(f"`{c}`") for c in df.columns], *encoded)


def _narrow(key: Column) -> Column:
    """A short key as it is, a long one by its SHA-256."""
    return F.when(F.octet_length(key) <= _SHORT_KEY, F.concat(F.lit("="), key)).otherwise(F.concat(F.lit("#"), F.sha2(key, 256)))


def hot_hashes(rows: DataFrame, keys: Sequence[str]) -> dict[str, list[int]]:
    """Hashes of the most frequent values of each column, from one frequent-items sketch each."""
    sketches = [F.expr(f"approx_top_k(xxhash64({k}), {HOT_KEYS}, {_TRACKED})").alias(k) for k in keys]
    top = rows.agg(*sketches).first()
    return {k: [item["item"] for item in top[k] or [] if item["count"] > 1] for k in keys}


def cold_probes(rows: DataFrame, keys: dict[str, str], hot: dict[str, list[int]]) -> DataFrame:
    """A row ``_row, column, _narrow`` for each cell whose value is not among the frequent ones."""
    cells = [
        F.when(~F.xxhash64(k).isin(hot[k]), F.struct(F.lit(c).alias("column"), F.col(k).alias("_narrow"))) for c, k in keys.items()
    ]
    return rows.select("_row", F.explode(F.array_compact(F.array(*cells))).alias("_probe")).select("_row", "_probe.*")
