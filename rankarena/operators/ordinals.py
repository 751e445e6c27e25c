"""Row numbers inside groups of any size."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
_PIECES = 256


def group_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def with_ordinal(
    df: DataFrame,
    *,
    scope: list[str],
    order: dict[str, bool],
    name: str = "ordinal",
    sizes_from: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Number the rows of each scope from 1.

    ``order`` maps sort columns to "ascending"; together with the scope they must identify a row, and a
    descending column must be numeric. Scopes of up to ``hot_rows`` rows are sorted by one task each. A larger
    scope is cut into ranges of its sort key which are sorted apart and then offset by the rows before them, so
    that it spreads over many tasks with the same result. Whether such scopes exist is looked up first, in
    ``sizes_from``: a cheaper table with the same scopes, or ``df`` itself.
    """
    sort_keys = [F.col(c).asc() if up else F.col(c).desc() for c, up in order.items()]
    sizes = group_sizes(df if sizes_from is None else sizes_from, scope)
    hot = sizes.where(F.col("n") > hot_rows)
    if hot.isEmpty():
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*scope).orderBy(*sort_keys)))

    # The sort key as one comparable value, in which all columns ascend. Descending, NaN comes first and null last, as
    # in the window above.
    def ascending(column: str, up: bool) -> list[Column]:
        value = F.col(column)
        if up:
            return [value]
        number = value.cast("double")
        return [value.isNull(), F.coalesce(~F.isnan(number), F.lit(True)), F.when(~F.isnan(number), -value)]

    parts = [part for c, up in order.items() for part in ascending(c, up)]
    key = F.struct(*[part.alias(f"k{i}") for i, part in enumerate(parts)])
    keyed = df.withColumn("_key", key)

    def same_scope(prefix: str) -> Column:
        """Scopes are equal, null included; the other side's columns have a prefix."""
        same = F.lit(True)
        for c in scope:
            same = same & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
        return same

    # Cut points: a share of the keys chosen by hash, hence the same ones whenever a task is run again. The
    # first filter is the largest share that any hot scope has, so only a small sample meets the sizes.
    chance = F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    cuts = (
        keyed.select(*scope, "_key")
        .where(chance < F.lit(_PIECES / hot_rows))
        .join(hot.select(*[F.col(c).alias(f"_h_{c}") for c in scope], "n"), same_scope("_h_"))
        .where(chance < F.lit(float(_PIECES)) / F.col("n"))
        .groupBy(*scope)
        .agg(F.sort_array(F.collect_set("_key")).alias("_cuts"))
    )
    # The explicit repartition matters: rows that were joined by scope would otherwise stay together by scope.
    pieces = (
        keyed.join(cuts.select(*[F.col(c).alias(f"_c_{c}") for c in scope], "_cuts"), same_scope("_c_"), "left")
        .withColumn("_piece", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_key"))), F.lit(0)))
        .withColumn("_piece", F.greatest("_piece", F.lit(0)))
        .drop("_cuts", *[f"_c_{c}" for c in scope])
        .repartition(*scope, "_piece")
    )
    # One row per piece: the running total covers a few hundred rows per scope.
    before = Window.partitionBy(*scope).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = group_sizes(pieces, [*scope, "_piece"]).select(
        *scope, "_piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset")
    )
    numbered = pieces.withColumn(
        "_place", F.row_number().over(Window.partitionBy(*scope, "_piece").orderBy("_key"))
    )
    offsets = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in scope], F.col("_piece").alias("_o_piece"), "_offset")
    return (
        numbered.join(offsets, same_scope("_o_") & (F.col("_piece") == F.col("_o_piece")))
        .withColumn(name, (F.col("_place") + F.col("_offset")).cast("int"))
        .select(*df.columns, name)
    )
