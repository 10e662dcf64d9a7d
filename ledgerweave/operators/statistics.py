"""Train-only statistics of each bank, and the plan they merge into.

Banks report counts, sums and distinct category values; only those small tables are
combined across banks. The plan is one table with a row per model feature:

    idx   position in the feature vector, numeric block first
    kind  'num' or 'cat'
    col, value   source column, and category value for 'cat'
    mean, std    scaling for 'num'
    name         num__<col> or cat__<col>_<value>
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerweave.settings import FeatureSpec
from ledgerweave.sources.durable import durable

# Features, or digests, that one digest of the plan's fingerprint covers.
DIGEST_RANGE = 4096


def train_rows(split_rows: DataFrame) -> DataFrame:
    return split_rows.where(F.col("split") == "train")


def category_vocab(split_rows: DataFrame, spec: FeatureSpec) -> DataFrame:
    """(bank_id, col, value): distinct category values a bank saw in training."""
    pairs = F.inline(
        F.array(
            *(
                F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value"))
                for c in spec.cat_cols
            )
        )
    )
    return (
        train_rows(split_rows)
        .select("bank_id", pairs)
        .where(F.col("value").isNotNull())
        .distinct()
    )


def _finite(name: str) -> Column:
    x = F.col(name).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def numeric_stats(split_rows: DataFrame, spec: FeatureSpec) -> DataFrame:
    """(bank_id, col, n, sum, sumsq) over finite training values; 0 when there are none."""
    totals = []
    for c in spec.num_cols:
        x = _finite(c)
        totals += [
            F.count(x).alias(f"n__{c}"),
            F.coalesce(F.sum(x), F.lit(0.0)).alias(f"sum__{c}"),
            F.coalesce(F.sum(x * x), F.lit(0.0)).alias(f"sumsq__{c}"),
        ]
    wide = train_rows(split_rows).groupBy("bank_id").agg(*totals)
    return wide.select(
        "bank_id",
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(c).alias("col"),
                        F.col(f"n__{c}").alias("n"),
                        F.col(f"sum__{c}").alias("sum"),
                        F.col(f"sumsq__{c}").alias("sumsq"),
                    )
                    for c in spec.num_cols
                )
            )
        ),
    )


def finalise_numeric(stats: DataFrame, keys: tuple[str, ...] = ("col",)) -> DataFrame:
    """Merge partial statistics into mean and population standard deviation.

    One value or none gives (0, 1), and a constant column gets std 1.
    """
    merged = stats.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("sumsq").alias("sumsq")
    )
    mean = F.col("sum") / F.col("n")
    variance = F.greatest(F.col("sumsq") / F.col("n") - mean * mean, F.lit(0.0))
    enough = F.col("n") > 1
    return merged.select(
        *keys,
        F.when(enough, mean).otherwise(F.lit(0.0)).alias("mean"),
        F.when(enough & (variance > 0), F.sqrt(variance)).otherwise(F.lit(1.0)).alias("std"),
    )


def union_vocab(vocab: DataFrame, keys: tuple[str, ...] = ("col",)) -> DataFrame:
    """(col, value, pos): the union of all vocabularies in byte order, from 0.

    Values are dealt into ranges by sampled bounds and stored with the number of their
    range. A value's position is the number of values in earlier ranges of its column, from
    one count per range, plus its place in its own range; no task ranks a whole column.
    """
    order = [*keys, "value"]
    ranged = durable(
        vocab.select(*order).distinct().repartitionByRange(*order).withColumn("range", F.spark_partition_id()),
        "vocabulary",
    )
    earlier = W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "range")
        .agg(F.count("*").alias("n"))
        .select(*keys, "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    inside = W.partitionBy(*keys, "range").orderBy("value")
    placed = ranged.withColumn("nth", F.row_number().over(inside))
    return placed.join(offsets, [*keys, "range"]).select(
        *order, (F.col("before") + F.col("nth") - 1).cast("int").alias("pos")
    )


def feature_plan(stats: DataFrame, vocab: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Merge every bank's statistics into the shared feature plan."""
    slot = {c: i for i, c in enumerate(spec.num_cols)}
    rank = {c: i for i, c in enumerate(spec.cat_cols)}

    def lookup(table: dict[str, int]) -> Column:
        chosen = F.lit(None).cast("int")
        for name, i in table.items():
            chosen = F.when(F.col("col") == name, i).otherwise(chosen)
        return chosen

    numeric = finalise_numeric(stats).select(
        lookup(slot).alias("idx"),
        F.lit("num").alias("kind"),
        "col",
        F.lit(None).cast("string").alias("value"),
        "mean",
        "std",
        F.concat(F.lit("num__"), F.col("col")).alias("name"),
    )
    positions = union_vocab(vocab)
    widths = positions.groupBy("col").agg(F.count("*").alias("width")).withColumn(
        "rank", lookup(rank)
    )
    before = W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    offsets = widths.select(
        "col", F.coalesce(F.sum("width").over(before), F.lit(0)).alias("offset")
    )
    categorical = positions.join(offsets, "col").select(
        (F.col("offset") + F.col("pos") + len(slot)).cast("int").alias("idx"),
        F.lit("cat").alias("kind"),
        "col",
        "value",
        F.lit(None).cast("double").alias("mean"),
        F.lit(None).cast("double").alias("std"),
        F.concat(F.lit("cat__"), F.col("col"), F.lit("_"), F.col("value")).alias("name"),
    )
    return numeric.unionByName(categorical)


def _in_order(order: str, text: str, least: str) -> Column:
    """The texts of a group joined by newlines, in the order of their numbers."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("text"))))
    return F.array_join(F.transform(pairs, lambda r: r["text"]), least)


def plan_fingerprint(plan: DataFrame, spec: FeatureSpec) -> DataFrame:
    """One row (plan_hash, plan_id, width): the root of a tree of SHA-1 digests.

    A leaf digests the lines of ``DIGEST_RANGE`` consecutive features, a node as many
    digests below it, on two levels, and the root the schema version and what is left. So
    no task gathers more than a range, whatever the width, and the root changes with any
    feature. Scaling values enter with ten significant digits, so a plan rebuilt from the
    same data keeps its fingerprint although parallel sums differ in their last bits.
    """

    def digits(name: str) -> Column:
        text = F.when(F.col(name).isNotNull(), F.format_string("%.9e", name))
        return F.coalesce(text, F.lit(""))

    line = F.concat_ws(
        "|",
        F.col("idx").cast("string"),
        "kind",
        "col",
        F.coalesce("value", F.lit("")),
        digits("mean"),
        digits("std"),
    )
    level = plan.select(F.col("idx").cast("bigint").alias("at"), line.alias("text"), F.lit(1).cast("bigint").alias("n"))
    for _ in range(2):
        level = (
            level.groupBy(F.floor(F.col("at") / DIGEST_RANGE).alias("range"))
            .agg(F.sha1(_in_order("at", "text", "\n")).alias("text"), F.sum("n").alias("n"))
            .withColumnRenamed("range", "at")
        )
    root = F.sha1(F.concat(F.lit(spec.version + "\n"), _in_order("at", "text", "\n")))
    return level.agg(root.alias("plan_hash"), F.sum("n").alias("width")).select(
        "plan_hash", F.substring("plan_hash", 1, 8).alias("plan_id"), "width"
    )
