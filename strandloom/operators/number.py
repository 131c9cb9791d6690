"""Row numbers of a total order without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys sampled for each range.
SAMPLED = 20


def last_upto(bounds: Column, key: Column, most: int) -> Column:
    """How many entries of a sorted array of at most `most` are no greater than key, by halving: as many steps as `most` has bits."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(most.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= key, at + step).otherwise(at))


def numbered(rows: DataFrame, order: list[Column], name: str, by: list[Column] = (), ranges: int | None = None) -> DataFrame:
    """rows with `name`: 1, 2, ... in the order of keys, whose last must tell rows apart; over all rows or for each value of `by`.

    Bounds of equal shares are told from SAMPLED keys for each range, the ones of smallest hash, so they are the same whenever they are
    asked for; a row finds its range by halving; rows are numbered inside their range, and the counts of the ranges before (one row each)
    are added. There are as many ranges as Spark's own sort would make. Rows are read three times (sample, counts, numbers) from one
    shuffle: it is dealt by every column, so all readings ask for the same and Spark runs it once. rows should hold only what is wanted.
    """
    spark = rows.sparkSession
    ranges = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = rows.withColumn("__by", F.struct(*by) if by else F.lit(0)).withColumn("__key", F.struct("__by", *(k.alias(f"k{i}") for i, k in enumerate(order))))
    keyed = keyed.repartition(*(F.col(f"`{c}`").isNull() if "map<" in kind else F.col(f"`{c}`") for c, kind in keyed.dtypes))  # maps have no hash
    sample = keyed.select("__key").orderBy(F.xxhash64("__key"), "__key").limit(SAMPLED * ranges)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    cut = sample.select("__key", F.row_number().over(Window.orderBy("__key")).alias("r"), n.alias("n")).where((F.col("r") * ranges / F.col("n")).cast("long") != ((F.col("r") - 1) * ranges / F.col("n")).cast("long"))
    bounds = cut.agg(F.array_sort(F.collect_list("__key")).alias("__bounds"))  # one row of as many keys as ranges
    one = F.lit(1).alias("__one")
    placed = keyed.select("*", one).join(F.broadcast(bounds.select("*", one)), "__one").drop("__one").withColumn("__range", last_upto(F.col("__bounds"), F.col("__key"), ranges)).drop("__bounds")
    before = placed.groupBy("__by", "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = before.select(F.col("__by").alias("__b"), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(Window.partitionBy("__by").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__by", "__range").orderBy("__key"))
    met = placed.withColumn("__inside", inside).join(before, F.col("__by").eqNullSafe(F.col("__b")) & (F.col("__range") == F.col("__r")))
    return met.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("__inside") + F.col("__before")).cast("long").alias(name))
