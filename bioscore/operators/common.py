"""Building blocks that keep work spread when one key holds much of the data.

No helper collects a whole key into one task: positions are counted per block,
running totals are taken in two levels, and pixel neighbourhoods are read inside
strips of bounded height.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def positions_within(df: DataFrame, key: str, order: str, out: str,
                     block: int = 4096) -> DataFrame:
    """Add the 0-based position of each row inside `key`, ordered by `order`.

    `order` is a unique whole number. Rows are counted per (key, block of the
    order), so a key with very many rows is numbered by many tasks.
    """
    rows = df.withColumn("_block", F.floor(F.col(order) / block))
    starts = (rows.groupBy(key, "_block").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(
                  Window.partitionBy(key).orderBy("_block")
                  .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .drop("_n"))
    rank = F.row_number().over(Window.partitionBy(key, "_block").orderBy(order))
    return (rows.join(starts, [key, "_block"])
            .withColumn(out, F.col("_before") + rank - 1)
            .drop("_block", "_before"))


def running(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str],
            value: str, out: str, how: str = "sum") -> DataFrame:
    """Running sum or maximum of `value` in `order`, in two levels.

    `bucket` must not decrease along `order`. Only bucket totals meet in one
    window per key; the rows themselves are accumulated bucket by bucket.
    """
    fold = F.sum if how == "sum" else F.max
    rows = df.withColumn("_bucket", bucket)
    totals = (rows.groupBy(*keys, "_bucket").agg(fold(value).alias("_total"))
              .withColumn("_carry", fold("_total").over(
                  Window.partitionBy(*keys).orderBy("_bucket")
                  .rowsBetween(Window.unboundedPreceding, -1)))
              .drop("_total"))
    inner = fold(value).over(Window.partitionBy(*keys, "_bucket").orderBy(*order)
                             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = rows.join(totals, [*keys, "_bucket"]).withColumn("_inner", inner)
    if how == "sum":
        result = F.col("_inner") + F.coalesce(F.col("_carry"), F.lit(0))
    else:
        result = F.greatest("_inner", "_carry")      # greatest() skips NULLs
    return joined.withColumn(out, result).drop("_bucket", "_carry", "_inner")


def running_sums(df: DataFrame, keys: Sequence[str], bucket: Column, order: str,
                 values: Sequence[str], more: dict[str, Column] | None = None) -> DataFrame:
    """Running sums of several columns in one two-level scan, and their totals per key.

    For a value c the columns c_run and c_all are added. `more` holds further figures of a key
    as aggregates over the bucket totals (columns c_sum, and _bucket).
    """
    rows = df.withColumn("_bucket", bucket)
    ordered = Window.partitionBy(*keys).orderBy("_bucket")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = rows.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"{c}_sum") for c in values])
    totals = totals.select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"{c}_sum").over(before), F.lit(0)).alias(f"{c}_carry") for c in values],
        *[F.sum(f"{c}_sum").over(whole).alias(f"{c}_all") for c in values],
        *[figure.over(whole).alias(name) for name, figure in (more or {}).items()])
    inner = (Window.partitionBy(*keys, "_bucket").orderBy(order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.join(totals, [*keys, "_bucket"])
            .select("*", *[(F.sum(c).over(inner) + F.col(f"{c}_carry")).alias(f"{c}_run") for c in values])
            .drop("_bucket", *[f"{c}_carry" for c in values]))


def lookup(df: DataFrame, figures: DataFrame, key: str | list[str], block: Column,
           how: str = "inner") -> DataFrame:
    """Join one row of figures per `key` (a column or several) to many rows of that key.

    `block` splits the rows of a key into bounded groups. The figures are first
    spread over the (key, block) groups that occur, and the wide join uses both,
    so a key with very many rows is not gathered in one task.
    """
    rows = df.withColumn("_block", block)
    keys = [key] if isinstance(key, str) else key
    spread = rows.select(*keys, "_block").distinct().join(figures, keys)
    return rows.join(spread, [*keys, "_block"], how).drop("_block")


def attach(raster: DataFrame, figures: DataFrame, how: str = "inner",
           strip: int = 64) -> DataFrame:
    """Join per-image figures to the pixels of the image.

    The figures are repeated per strip of rows and joined by (image, strip), so
    that even one image with a large share of all pixels stays spread. Figures
    without a height h get it from the raster; it is not kept then.
    """
    known = "h" in figures.columns
    if not known:
        figures = figures.join(
            raster.groupBy("image_id").agg((F.max("y") + 1).alias("h")), "image_id")
    strips = figures.withColumn("_s", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("h") - 1) / strip))))
    strips = strips if known else strips.drop("h")
    return (raster.withColumn("_s", F.floor(F.col("y") / strip))
            .join(strips, ["image_id", "_s"], how).drop("_s"))


def shuffle_tasks(df: DataFrame) -> int:
    """Tasks for rows that each stand for much work, which must not be joined by their few bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of vectors that a batch of wide vectors should hold, about.
BATCH_BYTES = 1 << 22


def modest_batches(df: DataFrame, row_bytes: int) -> DataFrame:
    """The same rows; from here on the session hands rows to Python in batches of about BATCH_BYTES at most.

    10,000 wide vectors, Spark's default, are copied several times in every Python process.
    """
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    most = max(64, BATCH_BYTES // max(row_bytes, 1))
    if not 0 < int(conf.get(key)) <= most:
        conf.set(key, str(most))
    return df


def explode_span(df: DataFrame, low: str, high: str, out: str, step: Column | int = 1,
                 chunk: int = 8192) -> DataFrame:
    """One row per whole number low, low+step, … < high.

    Long spans are first cut into chunks that are spread over the cluster, so a
    single very long span is not written out by one task. The number of tasks is given: chunks
    are few bytes, and adaptive execution would join them all in one task.
    """
    step = step if isinstance(step, Column) else F.lit(step)
    step = step.cast("long")
    kept = df.withColumn("_step", step).where(F.col(high) > F.col(low))
    kept = kept.withColumn("_last", F.floor((F.col(high) - 1 - F.col(low)) / F.col("_step")))
    cut = (kept.withColumn("_c", F.explode(F.expr(f"sequence(0L, _last div {chunk})")))
           .repartition(shuffle_tasks(df), F.col(low), F.col("_c")))
    first = F.col("_c") * chunk
    return (cut.withColumn("_k", F.explode(F.sequence(
                first, F.least(first + (chunk - 1), F.col("_last")))))
            .withColumn(out, F.col(low) + F.col("_k") * F.col("_step"))
            .drop("_step", "_last", "_c", "_k"))


def _beside(rows: DataFrame, value: str, reach: int, order, axis: str) -> tuple[DataFrame, list]:
    """Values of the cells -reach … reach places further on; NULL where a place is empty.

    Place and value travel as one struct, so each offset is a single window function.
    """
    if not reach:
        return rows, [F.col(value)]
    cell = F.struct(F.col(axis).alias("at"), F.col(value).alias("v"))
    offsets = [k for k in range(-reach, reach + 1) if k]
    rows = rows.withColumn("_cell", cell).select(
        "*", *[F.lag("_cell", -k).over(order).alias(f"_{axis}{k}") for k in offsets])
    other = lambda k: F.col(f"`_{axis}{k}`")
    values = [F.col(value) if k == 0 else F.when(other(k)["at"] == F.col(axis) + k, other(k)["v"])
              for k in range(-reach, reach + 1)]
    return rows, values


def neighbourhood(raster: DataFrame, value: str, rx: int, ry: int, out: str = "nb",
                  strip: int = 64,
                  across: Callable[[list[Column]], Column] | None = None) -> DataFrame:
    """Attach the (2·ry+1)×(2·rx+1) window around each pixel as a flat array.

    Row-major, NULL outside the image. The raster is cut into strips of `strip`
    rows with `ry` rows of overlap; one shuffle by (image, strip) serves both
    the horizontal and the vertical window, and no task needs a whole image.
    With `across` the 2·rx+1 values of a line are first combined into one, and
    the array holds that result for the 2·ry+1 lines (separable filters).
    """
    rows = raster
    if ry:
        lo = F.greatest(F.floor((F.col("y") - ry) / strip), F.lit(0))
        hi = F.greatest(F.floor((F.col("y") + ry) / strip), lo)
        rows = rows.withColumn("_s", F.explode(F.sequence(lo, hi)))
    else:
        rows = rows.withColumn("_s", F.floor(F.col("y") / strip))
    rows = rows.repartition("image_id", "_s")

    names = [*raster.columns, "_s"]
    line_order = Window.partitionBy("image_id", "_s", "y").orderBy("x")
    rows, line = _beside(rows, value, rx, line_order, "x")
    rows = rows.select(*names, (across(line) if across else F.array(*line)).alias("_h"))
    if not ry:
        return rows.withColumnRenamed("_h", out).drop("_s")

    kind = rows.schema[value].dataType.simpleString()
    empty = F.lit(None) if across else F.array_repeat(F.lit(None).cast(kind), 2 * rx + 1)
    column_order = Window.partitionBy("image_id", "_s", "x").orderBy("y")
    rows, lines = _beside(rows, "_h", ry, column_order, "y")
    lines = [F.coalesce(line, empty) for line in lines]
    rows = rows.select(*names, (F.array(*lines) if across else F.concat(*lines)).alias(out))
    return rows.where(F.col("_s") == F.floor(F.col("y") / strip)).drop("_s")


def on_strips(raster: DataFrame, keep: Sequence[str], reach: int, kernel: Callable, makes: str,
              strip: int = 64) -> DataFrame:
    """New pixel values from dense arrays of strips of `strip` rows with `reach` rows around.

    `kernel(place, **values)` gets the top row of its array, the image size if it is carried,
    and one array per column that is not in `keep`; cells without a pixel hold NaN. It gives
    the arrays of the columns named in `makes`. One shuffle by (image, strip), as in
    `neighbourhood`, and never more than a strip of one image in a kernel.
    """
    lo = F.greatest(F.floor((F.col("y") - reach) / strip), F.lit(0))
    rows = raster.withColumn("_s", F.explode(F.sequence(
        lo, F.greatest(F.floor((F.col("y") + reach) / strip), lo))))
    values = [c for c in raster.columns if c not in keep]
    made = T.StructType.fromDDL(makes)

    def run(table: pa.Table) -> pa.Table:
        number = table.column("_s")[0].as_py()
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        top = number * strip - reach
        place = {"top": top, **{c: table.column(c)[0].as_py() for c in ("w", "h") if c in keep}}
        grids = {}
        for name in values:
            grid = np.full((strip + 2 * reach, int(x.max()) + 1), np.nan)
            grid[y - top, x] = table.column(name).cast(pa.float64()).to_numpy()
            grids[name] = grid
        out = kernel(place, **grids)
        inner = y // strip == number
        cells = (y[inner] - top, x[inner])
        table = table.select(list(keep)).filter(pa.array(inner))
        for name in made.names:
            table = table.append_column(name, pa.array(out[name][cells]))
        return table

    schema = T.StructType([*[raster.schema[c] for c in keep], *made.fields])
    return rows.groupBy("image_id", "_s").applyInArrow(run, schema)


def shifted(grid: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The cells dy further down and dx further right; 0 outside."""
    out = np.zeros_like(grid)
    h, w = grid.shape
    out[max(-dy, 0):h - max(dy, 0), max(-dx, 0):w - max(dx, 0)] = \
        grid[max(dy, 0):h - max(-dy, 0), max(dx, 0):w - max(-dx, 0)]
    return out


def at(nb: str, dx: int, dy: int, rx: int, ry: int) -> Column:
    """Element of a `neighbourhood` array at offset (dx, dy)."""
    return F.col(nb)[(dy + ry) * (2 * rx + 1) + dx + rx]
