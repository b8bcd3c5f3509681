"""Order-dependent work on groups of any size.

A window over one hot key (or over no key at all) puts all its rows in one task. Here each ordered group is cut into
shards that follow the order; the window runs inside a shard, and one small row per shard carries the totals over the
cuts. The shards are cut at approximate quantiles read once from the data (a fixed number of values), so they hold about
the same number of rows whatever the distribution, and every result stays exact because any cut gives the same totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trustloom.session import shard_count

HOT_ROWS = 5_000_000


def cut_points(df: DataFrame, value: Column, n: int) -> list[float]:
    """At most ``n - 1`` approximate quantiles of a number, with repeats where one value is frequent."""
    probs = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(value.cast("double"), probs, 10_000).alias("q")).first()
    return sorted(row["q"] or [])


def _numeric(df: DataFrame, name: str) -> Column:
    """A number that never decreases along the column; of a text its first six bytes."""
    kind = df.schema[name].dataType.typeName()
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.encode(F.substring(name, 1, 6), "utf-8")), 12, "0"), 16, 10).cast("double")
    return F.unix_micros(name).cast("double") if kind.startswith("timestamp") else F.col(name).cast("double")


def _position(df: DataFrame, value: Column, cuts: Sequence[float], out: str) -> DataFrame:
    """Number of cuts at or below the value (binary search inside the JVM)."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    inf = float("inf")
    marked = df.withColumn("_v", value)
    binned = Bucketizer(splits=[-inf, *cuts, inf], inputCol="_v", outputCol="_b", handleInvalid="keep").transform(marked)
    return binned.withColumn(out, F.col("_b").cast("int")).drop("_b", "_v")


def with_shards(df: DataFrame, order: Sequence[str], n: int | None = None) -> DataFrame:
    """Add ``_shard``, an integer that never decreases along ``order``.

    A frequent first key (say, one instant for a third of the rows) gets shards of its own, cut along the second key.
    """
    n = n or shard_count(df.sparkSession)
    first = _numeric(df, order[0])
    found = cut_points(df, first, n)
    cuts = sorted(set(found))
    # texts that only begin alike may not be cut along the second key
    hot = sorted({v for v in cuts if found.count(v) > 1}) if df.schema[order[0]].dataType.typeName() != "string" else []
    out = _position(df, first, cuts, "_p")
    if not cuts:
        return out.withColumnRenamed("_p", "_shard")
    at_cut = (F.col("_p") > 0) & (F.get(F.array(*map(F.lit, cuts)), F.col("_p") - 1) == first)
    base = 2 * F.col("_p") - F.when(at_cut, 1).otherwise(0)
    second: list[float] = []
    if hot and len(order) > 1:
        second = sorted(set(cut_points(df.where(first.isin(hot)), _numeric(df, order[1]), n)))
    if second:
        out = _position(out, _numeric(df, order[1]), second, "_q")
        shard = base * (len(second) + 1) + F.when(first.isin(hot), F.col("_q")).otherwise(0)
        return out.withColumn("_shard", shard).drop("_p", "_q")
    return out.withColumn("_shard", base).drop("_p")


def group_key(group: Sequence[str]) -> Column:
    """The group columns as one value that is never null itself, so that joins on it also match groups with null parts."""
    return F.struct(*[F.col(c) for c in group] or [F.lit(0).alias("all")])


def _offsets(df: DataFrame, sums: Sequence[str], descending: bool) -> DataFrame:
    """Totals of all earlier shards: one row per (group, shard), so a window over them is small."""
    per_shard = df.groupBy("_g", "_shard").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    order = F.col("_shard").desc() if descending else F.col("_shard").asc()
    w = W.partitionBy("_g").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return per_shard.select("_g", "_shard", *[
        F.coalesce(F.sum(f"_t_{c}").over(w), F.lit(0)).alias(f"_o_{c}") for c in sums])


def running_sums(df: DataFrame, group: Sequence[str], value: str, sums: Sequence[str], descending: bool = False,
                 n: int | None = None) -> DataFrame:
    """Running totals along ``value`` as ``run_<name>``, one row per distinct value of each group."""
    group = list(group)
    points = df.groupBy(*group, value).agg(*[F.sum(c).alias(c) for c in sums])
    sharded = with_shards(points, [value], n).withColumn("_g", group_key(group))
    offsets = _offsets(sharded, sums, descending)
    order = F.col(value).desc() if descending else F.col(value).asc()
    w = W.partitionBy("_g", "_shard").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    keyed = sharded.join(offsets, ["_g", "_shard"])
    return keyed.select(*group, value, *sums, *[(F.sum(c).over(w) + F.col(f"_o_{c}")).alias(f"run_{c}") for c in sums])


def row_numbers(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int | None = None) -> DataFrame:
    """Add ``rn``, the position (from 1) of each row of its group along ``order``."""
    group = list(group)
    sharded = with_shards(df, order, n).withColumns({"_one": F.lit(1), "_g": group_key(group)})
    offsets = _offsets(sharded, ["_one"], False)
    w = W.partitionBy("_g", "_shard").orderBy(*order)
    keyed = sharded.join(offsets, ["_g", "_shard"])
    return keyed.withColumn("rn", F.row_number().over(w) + F.col("_o__one")).drop("_g", "_shard", "_one", "_o__one")


def rolling_rows(df: DataFrame, group: Sequence[str], size: int, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over the last ``size`` rows by ``rn``: blocks of ``size`` rows, each with a copy of the block before.

    A window group never holds more than ``2 * size`` rows.
    """
    block = F.floor((F.col("rn") - 1) / size)
    copies = df.withColumn("_c", F.explode(F.array(
        F.struct(block.alias("block"), F.lit(False).alias("copy")),
        F.struct((block + 1).alias("block"), F.lit(True).alias("copy")))))
    flat = copies.withColumns({"_block": F.col("_c.block"), "_copy": F.col("_c.copy")}).drop("_c")
    w = W.partitionBy(*group, "_block").orderBy("rn").rowsBetween(1 - size, 0)
    out = flat.withColumns({name: agg.over(w) for name, agg in aggs.items()})
    return out.where(~F.col("_copy")).drop("_block", "_copy")


def quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float], n: int | None = None) -> DataFrame:
    """Exact interpolated quantiles as ``q0, q1, ...`` per group, for groups of any size."""
    group = list(group)
    counted = df.where(F.col(value).isNotNull()).select(*group, value, F.lit(1).alias("n"))
    runs = running_sums(counted, group, value, ["n"], n=n)
    runs = runs.withColumn("_g", group_key(group))
    placed = runs.join(runs.groupBy("_g").agg(F.sum("n").alias("total")), "_g")
    before, upto, last = F.col("run_n") - F.col("n"), F.col("run_n"), F.col("total") - 1
    picks = []
    for i, p in enumerate(probs):
        lo, hi = F.floor(last * p), F.ceil(last * p)
        picks += [F.max(F.when((before <= r) & (r < upto), F.col(value))).alias(f"_{side}{i}")
                  for side, r in (("lo", lo), ("hi", hi))]
    picked = placed.groupBy(*group).agg(F.max("total").alias("total"), *picks)
    frac = [(F.col("total") - 1) * p - F.floor((F.col("total") - 1) * p) for p in probs]
    return picked.select(*group, *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * f).alias(f"q{i}") for i, f in enumerate(frac)])


def attach(df: DataFrame, stats: DataFrame, keys, spread: str, size: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join one row of statistics per key back to the rows, without sending a hot key's rows to one task.

    ``size`` is the column of ``stats`` with the rows per key. Keys above ``hot_rows`` number at most
    ``rows / hot_rows``, so their statistics are broadcast; their rows (and rows without a key) are spread by the hash of
    ``spread`` in the ordinary join that serves all other keys.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = [c for c in stats.columns if c not in keys]
    hot = stats.where(F.col(size) > hot_rows).select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in cols])
    # always 0, but not a literal: the optimizer would turn a literal into a filter and leave the salt out of the shuffle
    unsalted = F.pmod(F.col(size).cast("bigint"), F.lit(1).cast("bigint")).alias("_salt")
    cold = stats.where(F.col(size) <= hot_rows).select(*keys, *cols, unsalted)
    lone = F.col(f"_hot_{size}").isNotNull()
    for k in keys:
        lone = lone | F.col(k).isNull()
    salted = df.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(lone, 1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20))).otherwise(F.lit(0).cast("bigint")))
    joined = salted.join(cold, [*keys, "_salt"], "left")
    return joined.select(*df.columns, *[F.coalesce(F.col(f"_hot_{c}"), F.col(c)).alias(c) for c in cols])
