"""Agreement of two raters, result-set comparison, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import f_measure, jaccard, ratio_or, wilson
from .ranking import global_row_number


def confusion(rows: DataFrame, label: str, truth: str, guess: str) -> DataFrame:
    """tp, fp, fn, tn of boolean columns for each label."""
    t, g = F.col(truth), F.col(guess)
    count = lambda c: F.count_if(c)
    return rows.groupBy(label).agg(count(t & g).alias("tp"), count(~t & g).alias("fp"), count(t & ~g).alias("fn"), count(~t & ~g).alias("tn"))


def scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and their intervals from ``confusion``."""
    precision, recall = ratio_or(F.col("tp"), F.col("tp") + F.col("fp"), None), ratio_or(F.col("tp"), F.col("tp") + F.col("fn"), None)
    p_low, p_high = wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    r_low, r_high = wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    named = {"precision": precision, "recall": recall, "precision_low": p_low, "precision_high": p_high, "recall_low": r_low, "recall_high": r_high}
    out = counts.withColumns(named).withColumn("f1", f_measure(F.col("precision"), F.col("recall")))
    return out.withColumns({c: F.round(c, 6) for c in [*named, "f1"]})


def overall(counts: DataFrame) -> DataFrame:
    """One row from ``confusion``: micro figures from the sums, macro ones as means over the labels that have them; 0 where there is nothing to divide by."""
    share = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    mean = lambda part, whole: F.coalesce(F.avg(F.try_divide(part.cast("double"), whole.cast("double"))), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    summed = counts.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), mean(tp, tp + fp).alias("macro_precision"), mean(tp, tp + fn).alias("macro_recall"), mean(2 * tp, 2 * tp + fp + fn).alias("macro_f1"))
    micro = summed.withColumns({"micro_precision": share(tp, tp + fp), "micro_recall": share(tp, tp + fn), "micro_f1": share(2 * tp, 2 * tp + fp + fn)})
    return micro.withColumns({c: F.round(c, 6) for c in micro.columns if c.startswith(("micro", "macro"))})


def fitted_total(sample: DataFrame, y: str, x: str, whole: DataFrame) -> DataFrame:
    """Line of ``y`` over ``x`` in a sample, the deviation of its residuals, and a 95 % interval of the sum of ``y`` over ``whole``, one row with ``n`` rows and their sum of ``x``."""
    squares = F.greatest(F.regr_syy(y, x) - F.try_divide(F.regr_sxy(y, x) * F.regr_sxy(y, x), F.regr_sxx(y, x)), F.lit(0.0))
    fit = sample.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.sqrt(squares / (F.count("*") - 1)).alias("residual_sd"))
    both = fit.crossJoin(F.broadcast(whole.toDF("_n", "_x")))
    total, half = F.col("intercept") * F.col("_n") + F.col("slope") * F.col("_x"), 1.96 * F.col("residual_sd") * F.sqrt("_n")
    return both.select("slope", "intercept", "residual_sd", total.alias("total"), (total - half).alias("low"), (total + half).alias("high"))


def set_agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Exact matches and mean Jaccard of two array columns."""
    same = (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    return rows.agg(F.count("*").alias("n"), F.count_if(same).alias("exact"), F.round(F.avg(jaccard(F.col(a), F.col(b))), 6).alias("mean_jaccard"))


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    """``row``: all values of a row in its columns' order as text, numbers rounded to ``digits`` places."""

    def text(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegralType, T.DecimalType, T.FractionalType)):
            number = c.cast("double")
            c = F.when(F.isnan(number), F.lit("NaN")).otherwise((F.round(number, digits) + F.lit(0.0)).cast("string"))
        return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))

    return df.select(F.to_json(F.array(*map(text, df.schema.fields))).alias("row"))


def compared(a: DataFrame, b: DataFrame, *, digits: int = 6) -> DataFrame:
    """One row: ``n_a``, ``n_b`` and ``is_same``, whether two results of any size hold equal rows equally often, whatever their columns are called.

    Rows are counted where they are; only counts of equal rows are joined.
    """
    sides = [_rounded(df, digits).groupBy("row").agg(F.count("*").alias(n)) for df, n in ((a, "_a"), (b, "_b"))]
    both = sides[0].join(sides[1], "row", "full").select(F.coalesce("_a", F.lit(0)).alias("_a"), F.coalesce("_b", F.lit(0)).alias("_b"))
    return both.agg(F.coalesce(F.sum("_a"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("_b"), F.lit(0)).alias("n_b"), (F.count_if(F.col("_a") != F.col("_b")) == 0).alias("is_same"))


def compared_in_order(a: DataFrame, b: DataFrame, order_a: Sequence[Column], order_b: Sequence[Column], *, digits: int = 6) -> DataFrame:
    """The same where order counts: rows are numbered, by ranges, and their numbers are compared with them."""
    return compared(global_row_number(a, order_a, "_at"), global_row_number(b, order_b, "_at"), digits=digits)
