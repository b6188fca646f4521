"""Totals at every level of some dimensions, with exact or sketched distinct counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pagetables.sources.tables import work_partitions

#: Buckets of a sketch, as a power of two; the standard error is about 0.83 / sqrt(2 ** 12) = 1.3 %.
LG_K = 12
#: Distinct values that are told apart by the bits of one number, and the rows from which a value may be one of them.
HOT_VALUES, HOT_ROWS = 63, 100_000


def levels_of(dims: list[str], kind: str) -> list[list[str]]:
    """The groupings of a ``kind``: 'cube' or 'rollup' over ``dims``."""
    if kind == "rollup":
        return [dims[:n] for n in range(len(dims), -1, -1)]
    if kind != "cube":
        raise ValueError("kind is 'cube' or 'rollup'")
    return [[d for i, d in enumerate(dims) if not bits >> i & 1] for bits in range(1 << len(dims))]


def hot_values(rows: DataFrame, item: str, least: int) -> DataFrame | None:
    """The values of ``item`` with the most rows, more than ``least``, and a ``_bit`` of a number for each; None if there
    are none. Every other value has at most a 64th of all rows, or ``least``."""
    most = rows.filter(F.col(item).isNotNull()).groupBy(item).agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") > least).orderBy(F.desc("_n")).limit(HOT_VALUES).select(item).collect()
    if not most:
        return None
    kind = StructType([StructField(item, rows.schema[item].dataType), StructField("_bit", LongType())])
    return rows.sparkSession.createDataFrame([(r[0], 1 << i) for i, r in enumerate(most)], kind)


def _dealt(folded: DataFrame, names: list[str], hot: DataFrame | None) -> DataFrame:
    """The rows dealt by ``_item``; those without one, and hot ones, which keep their ``_bit`` instead, by a ``_spot`` of
    their group. The number of tasks is given: each makes a copy for every level, so it must not follow the bytes."""
    if hot is None:
        folded = folded.withColumn("_bit", F.lit(None).cast("long"))
    else:
        folded = folded.join(F.broadcast(hot), "_item", "left").withColumn(
            "_item", F.when(F.col("_bit").isNull(), F.col("_item")))
    return folded.withColumn("_spot", F.when(F.col("_item").isNull(), F.xxhash64(*names))).repartition(
        work_partitions(folded.sparkSession), "_item", "_spot")


def level_totals(df: DataFrame, dims: list[str], value: str, distinct: str,
                 levels: list[list[str]] | str = "cube", exact: bool = True, lg_k: int = LG_K) -> DataFrame:
    """Rows, total ``value`` and different ``distinct`` at every level.

    One row for each level and group: ``level``, the dimensions that the row is summed over as a bit mask (the last
    dimension is bit 0, as ``grouping_id``), the dimensions (NULL where summed over), ``n_rows, total, n_distinct``. A NULL in
    a dimension is a group of its own, told from a total by ``level``; NULL is no ``distinct`` value. ``value``
    should be a decimal or a whole number, so that totals do not depend on the order. The level without dimensions
    has one row, also for an empty table if it is asked for; others have none.

    Rows are first folded to one for each (dimensions, distinct value), or with ``exact=False`` to one sketch of
    bounded size for each group of all dimensions; only these are copied for the levels. For exact counts
    the folded rows are dealt by their distinct value, so that the copies of a value meet in the task that made them and
    are counted there; only the partial totals of (level, group) are shuffled. The grand total, or a group with a third of
    all rows, never meets in one task row by row. Nor does a distinct value with very many rows: the most frequent
    ones (``hot_values``, found by a pass over that column) are dealt by their group and counted by one bit each.
    """
    wanted = levels_of(dims, levels) if isinstance(levels, str) else levels
    names = [f"_d{i}" for i in range(len(dims))]
    rows = df.select(*(F.col(f"`{d}`").alias(n) for d, n in zip(dims, names)),
                     F.col(f"`{value}`").alias("_value"), F.col(f"`{distinct}`").alias("_item"))
    totals = [F.count(F.lit(1)).alias("n_rows"), F.sum("_value").alias("total")]
    again = [F.sum("n_rows").alias("n_rows"), F.sum("total").alias("total")]
    if exact:
        folded = _dealt(rows.groupBy(*names, "_item").agg(*totals), names, hot_values(rows, "_item", HOT_ROWS))
    else:
        text = F.col("_item").cast("string")
        folded = rows.groupBy(*names).agg(*totals, F.hll_sketch_agg(text, lg_k).alias("_sketch"))

    def level(kept: list[str]) -> Column:
        mask = sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in kept)
        return F.struct(F.lit(mask).cast("long").alias("level"), *(
            (F.col(n) if d in kept else F.lit(None).cast(rows.schema[n].dataType)).alias(n)
            for d, n in zip(dims, names)))

    copied = folded.withColumn("_l", F.explode(F.array(*map(level, wanted)))).drop(*names).select("_l.*", "*").drop("_l")
    if exact:
        items = copied.groupBy("level", *names, "_item", "_spot").agg(*again, F.bit_or("_bit").alias("_bits"))
        hot = F.coalesce(F.bit_count(F.bit_or("_bits")), F.lit(0))
        out = items.groupBy("level", *names).agg(*again, (F.count("_item") + hot).alias("n_distinct"))
    else:
        out = copied.groupBy("level", *names).agg(*again, F.hll_sketch_estimate(
            F.hll_union_agg("_sketch")).alias("n_distinct"))
    if [] in wanted:
        # an empty table has no rows to copy for the grand total
        top = (1 << len(dims)) - 1
        kinds = {f.name: f.dataType for f in out.schema}
        none = df.sparkSession.range(1).select(*(
            F.lit(top if n == "level" else 0 if n in ("n_rows", "n_distinct") else None).cast(kinds[n]).alias(n)
            for n in out.columns)).withColumn("_none", F.lit(True))
        both = out.withColumn("_none", F.lit(False)).unionByName(none)
        grand = both.filter(F.col("level") == top).groupBy().agg(*(
            F.min_by(n, "_none").alias(n) for n in out.columns))
        out = out.filter(F.col("level") != top).unionByName(grand)
    return out.select("level", *(F.col(n).alias(d) for n, d in zip(names, dims)), "n_rows", "total", "n_distinct")

