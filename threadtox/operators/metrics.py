"""Evaluation of scoring systems: exact AUROC (ties count half) per group, DeLong interval, binned AUC,
threshold metrics, MCCV mean ± standard error, and a paired approximate-randomisation test.

All metrics are aggregate plans: rows are first collapsed to one row per (group, distinct score), and the
ordered part runs through :func:`running_totals` so that a group with millions of distinct scores is still
spread over many tasks. Only the final per-group numbers are small.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadtox.operators.ranking import running_totals

# --- fixed values -------------------------------------------------------------------------------
Z_95 = 1.959963984540054          # two-sided 95% normal quantile
THRESHOLD = 0.5                   # decision threshold (strictly greater is positive)
BINNED_THRESHOLDS = 200           # thresholds of the binned, training-time AUC
# -------------------------------------------------------------------------------------------------


def _attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join a per-key table (one row per key) onto ``df``; an empty key list joins on a constant."""
    if keys:
        return df.join(small, list(keys), "inner")
    return (df.withColumn("__one", F.lit(1)).join(F.broadcast(small.withColumn("__one", F.lit(1))), "__one")
            .drop("__one"))


BUCKETS_PER_OCTAVE = 64


def score_bucket(score: Column, per_octave: int = BUCKETS_PER_OCTAVE) -> Column:
    """A monotone coarsening of any double: ``per_octave`` buckets between two powers of two, on both sides of 0.

    Like a double's leading bits it follows the magnitude of the scores, so probabilities crowded near 0 and logits
    spread as evenly as scores over [0, 1]. NaN comes last, as in Spark's order. At most 4 200 * per_octave values."""
    size = F.abs(score)
    octave = F.floor(F.log2(size))
    # octave * n + (size / 2^octave - 1) * n has no step at a power of two: an octave that is off by one there
    # (rounding of log2) gives the same bucket
    place = octave * per_octave + F.floor((size / F.pow(F.lit(2.0), octave) - 1) * per_octave) + 1100 * per_octave
    top = 1 << 40
    return (F.when(F.isnan(score), F.lit(top + 1)).when(score == float("inf"), F.lit(top)).when(score == float("-inf"), F.lit(-top))
            .when(score == 0, F.lit(0)).when(score > 0, place).otherwise(-place)).cast("long")


def score_table(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label",
                n_keys: int | None = None, weight: str | None = None) -> DataFrame:
    """One row per (keys, distinct score): pos, neg, pos_below, neg_below (strictly lower scores), P, N. With an integer
    ``weight`` a row counts that often.

    ``n_keys`` is kept for callers; how the bucket offsets are joined is left to AQE, which sees their size."""
    keys = list(keys)
    n = F.lit(1) if weight is None else F.col(weight)
    g = (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
         .groupBy(*keys, F.col(score).alias("score"))
         .agg(F.sum(F.when(F.col(label) == 1, n).otherwise(0)).cast("long").alias("pos"),
              F.sum(F.when(F.col(label) == 1, 0).otherwise(n)).cast("long").alias("neg")))
    rt = running_totals(g, keys, [F.col("score")], [score_bucket(F.col("score").cast("double"))],
                        {"pos_below": F.col("pos"), "neg_below": F.col("neg")}, totals=True)
    return rt.withColumnRenamed("total_pos_below", "P").withColumnRenamed("total_neg_below", "N")


def _degenerate(value: Column, ok: Column, degenerate: str) -> Column:
    fallback = {"null": F.lit(None).cast("double"), "one": F.lit(1.0), "zero": F.lit(0.0)}[degenerate]
    return F.when(ok, value).otherwise(fallback)


def auroc(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label",
          degenerate: str = "null", n_keys: int | None = None, weight: str | None = None) -> DataFrame:
    """Exact area under the ROC curve per group: keys, n_pos, n_neg, auroc. An integer ``weight`` repeats rows.

    auroc = sum over positives of (#negatives scored lower + half the tied negatives) / (P * N), with the
    numerator kept as an exact integer (2x) until the final division. ``degenerate`` picks the value for a
    group that lacks one class: 'null' (default), 'one' or 'zero'.
    """
    keys = list(keys)
    st = score_table(df, keys, score, label, n_keys, weight)
    num = F.col("pos").cast("decimal(38,0)") * (F.lit(2) * F.col("neg_below") + F.col("neg")).cast("decimal(38,0)")
    agg = st.groupBy(*keys).agg(F.sum(num).alias("__num"), F.first("P").alias("n_pos"), F.first("N").alias("n_neg"))
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    value = F.col("__num").cast("double") / (F.lit(2.0) * F.col("n_pos").cast("double") * F.col("n_neg").cast("double"))
    return agg.select(*keys, F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"),
                      _degenerate(value, ok, degenerate).alias("auroc"))


def auroc_ci(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label",
             level_z: float = Z_95, n_keys: int | None = None) -> DataFrame:
    """AUROC with DeLong's variance and a normal interval (clipped to [0, 1]).

    Per positive: V10 = (negatives below + half tied) / N; per negative: V01 = (positives above + half
    tied) / P; var = s²(V10) / P + s²(V01) / N with sample variances. Every row at one distinct score has
    the same component, so the sums run over the score table, weighted by counts.
    """
    keys = list(keys)
    st = score_table(df, keys, score, label, n_keys)
    n_pos, n_neg = F.col("P").cast("double"), F.col("N").cast("double")
    # guarded divisions: a group missing a class gets nulls instead of a division error
    v10 = F.when(F.col("N") > 0, (F.col("neg_below") + F.lit(0.5) * F.col("neg")) / n_neg)
    v01 = F.when(F.col("P") > 0, (F.col("P") - F.col("pos_below") - F.col("pos") + F.lit(0.5) * F.col("pos")) / n_pos)
    agg = st.groupBy(*keys).agg(
        F.sum(F.col("pos") * v10).alias("__s10"), F.sum(F.col("pos") * v10 * v10).alias("__q10"),
        F.sum(F.col("neg") * v01 * v01).alias("__q01"),
        F.first("P").alias("n_pos"), F.first("N").alias("n_neg"))
    p, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    auc = F.when(p > 0, F.col("__s10") / p)
    s10 = (F.col("__q10") - p * auc * auc) / (p - F.lit(1.0))
    s01 = (F.col("__q01") - n * auc * auc) / (n - F.lit(1.0))
    var = s10 / p + s01 / n
    ok = (F.col("n_pos") > 1) & (F.col("n_neg") > 1)
    out = agg.select(*keys, F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"),
                     F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), auc).alias("auroc"),
                     F.when(ok, var).alias("variance"))
    half = F.lit(level_z) * F.sqrt(F.col("variance"))
    return out.select("*", F.greatest(F.lit(0.0), F.col("auroc") - half).alias("ci_low"),
                      F.least(F.lit(1.0), F.col("auroc") + half).alias("ci_high"))


def poisson_thresholds(mean: float = 1.0, digits: int = 8) -> list[str]:
    """Hex numbers t[0] < t[1] < ... with P(k <= j) = t[j] / 16^digits for a Poisson count k, as far as they differ."""
    out, term, total, k = [], math.exp(-mean), 0.0, 0
    while True:
        total += term
        k += 1
        term *= mean / k
        t = round(total * 16 ** digits)
        if t >= 16 ** digits or (out and f"{t:0{digits}x}" == out[-1]):
            return out
        out.append(f"{t:0{digits}x}")


DRAWS = 4   # 8-digit draws of one md5


def bootstrap_weights(df: DataFrame, replicates: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """``df`` once for each replicate (1 .. replicates) in which the row is drawn, with its ``draws``.

    The number of draws is Poisson(1), read from 8 hex digits of md5(seed:block:id), where a block is ``DRAWS`` replicates: a
    Poisson bootstrap, which needs no count of the rows and no exchange, and is the same on every run. Rows that share
    an id share their draws; a null id counts as ''.
    """
    limits = poisson_thresholds()
    blocks = -(-replicates // DRAWS)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__block").cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))

    def draws(i: int) -> Column:
        digits = F.substring("__md5", 8 * i + 1, 8)
        n = F.when(digits < F.lit(limits[0]), 0)
        for k in range(1, len(limits)):
            n = n.when(digits < F.lit(limits[k]), k)
        return n.otherwise(len(limits))

    one = F.array(*(F.struct((F.col("__block") * DRAWS + i + 1).alias("replicate"), draws(i).alias("draws")) for i in range(DRAWS)))
    rows = df.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("__md5", digest)
    return rows.withColumn("__draw", F.explode(F.filter(one, lambda x: (x["draws"] > 0) & (x["replicate"] <= replicates)))) \
        .select(*df.columns, F.col("__draw.replicate").alias("replicate"), F.col("__draw.draws").alias("draws"))


def auroc_bootstrap(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label", id_col: str = "id",
                    replicates: int = 200, seed: int = 42, level: float = 0.95) -> DataFrame:
    """AUROC with a percentile interval from a Poisson bootstrap: keys, auroc, replicates, ci_low, ci_high.

    Of the drawn rows only (replicate, distinct score, class) totals are shuffled, summed map-side first; every
    replicate's AUROC is exact. Replicates that lack a class are left out (``replicates`` counts the rest), and a group
    without a usable one has no interval.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(id_col).alias("__id"), F.col(score).alias("score"), F.col(label).alias("label")) \
        .where("score IS NOT NULL AND label IS NOT NULL")
    drawn = auroc(bootstrap_weights(rows, replicates, seed, "__id"), [*keys, "replicate"], weight="draws")
    tail = (1 - level) / 2
    limits = drawn.groupBy(*keys).agg(F.count("auroc").alias("replicates"), F.percentile("auroc", F.lit(tail)).alias("ci_low"),
                                      F.percentile("auroc", F.lit(1 - tail)).alias("ci_high"))
    whole = auroc(rows, keys).select(*keys, "auroc")
    if not keys:
        return _attach(whole, limits, [])  # one row each
    return whole.join(limits, keys, "left").withColumn("replicates", F.coalesce("replicates", F.lit(0)).cast("long"))


def binned_score(score: Column, thresholds: int = BINNED_THRESHOLDS) -> Column:
    """Index (1 .. thresholds-1) of the last of the evenly spaced thresholds 0-eps, 1/(t-1), .. that the
    score strictly exceeds; two scores in one bin are indistinguishable to the binned AUC."""
    m = thresholds - 1
    return F.lit(1) + F.greatest(F.lit(0), F.least(F.lit(m - 1), F.ceil(score * F.lit(float(m))) - F.lit(1)))


def auc_binned(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label",
               thresholds: int = BINNED_THRESHOLDS, n_keys: int | None = None) -> DataFrame:
    """Training-time AUC: ROC over fixed thresholds, trapezoid rule. The trapezoid over the threshold grid
    equals the exact tie-aware AUROC of the binned score, so the same plan is reused (groups missing a class
    give 0, as the rate divisions return 0 there)."""
    b = df.withColumn("__bin", binned_score(F.col(score), thresholds))
    return auroc(b, keys, "__bin", label, degenerate="zero", n_keys=n_keys).withColumnRenamed("auroc", "auc_binned")


def confusion(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label",
              threshold: float = THRESHOLD) -> DataFrame:
    """tp, fp, tn, fn at ``score > threshold``."""
    pred = F.col(score) > F.lit(threshold)
    pos = F.col(label) == 1

    def count_if(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return df.groupBy(*keys).agg(count_if(pred & pos).alias("tp"), count_if(pred & ~pos).alias("fp"),
                                 count_if(~pred & ~pos).alias("tn"), count_if(~pred & pos).alias("fn"))


def threshold_metrics(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label",
                      threshold: float = THRESHOLD) -> DataFrame:
    """accuracy, precision, recall at the threshold (0 when a denominator is 0)."""
    c = confusion(df, keys, score, label, threshold)

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select("*", ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
                    ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))


def class_prior(df: DataFrame, keys: Sequence[str] = (), label: str = "label") -> DataFrame:
    """pos, neg, prior = pos / n and the initial output bias log(pos / neg) (unweighted)."""
    agg = df.groupBy(*keys).agg(F.sum(F.col(label)).cast("long").alias("pos"),
                                F.sum(F.lit(1) - F.col(label)).cast("long").alias("neg"))
    return agg.select("*", (F.col("pos") / (F.col("pos") + F.col("neg"))).alias("prior"),
                      F.when((F.col("pos") > 0) & (F.col("neg") > 0),
                             F.log(F.col("pos") / F.col("neg"))).alias("bias"))


def calibration_in_large(df: DataFrame, keys: Sequence[str] = (), score: str = "score",
                         label: str = "label") -> DataFrame:
    """Mean predicted score next to the mean gold rate."""
    return df.groupBy(*keys).agg(F.avg(F.col(score)).alias("mean_score"),
                                 F.avg(F.col(label).cast("double")).alias("gold_rate"),
                                 F.count(F.lit(1)).alias("n"))


def mccv_summary(per_split: DataFrame, keys: Sequence[str] = (), metric: str = "auroc") -> DataFrame:
    """Mean and standard error (ddof = 1) of a metric over splits."""
    return per_split.groupBy(*keys).agg(
        F.count(F.col(metric)).alias("n_splits"), F.avg(F.col(metric)).alias("mean"),
        (F.stddev_samp(F.col(metric)) / F.sqrt(F.count(F.col(metric)).cast("double"))).alias("sem"))


SWAPS = 32   # swaps read from one md5
EVALUATORS = ("auroc", "auc_binned", "accuracy")


def evaluate(df: DataFrame, keys: Sequence[str], evaluator: str, score: str = "score",
             label: str = "label", n_keys: int | None = None) -> DataFrame:
    """Metric named by ``evaluator`` per group, in a column called ``value``."""
    if evaluator == "auroc":
        return auroc(df, keys, score, label, n_keys=n_keys).select(*keys, F.col("auroc").alias("value"))
    if evaluator == "auc_binned":
        return auc_binned(df, keys, score, label, n_keys=n_keys).select(*keys, F.col("auc_binned").alias("value"))
    if evaluator == "accuracy":
        return threshold_metrics(df, keys, score, label).select(*keys, F.col("accuracy").alias("value"))
    raise ValueError(f"evaluator must be one of {EVALUATORS}")


def paired_randomization(df: DataFrame, system: str, baseline: str, label: str = "label", id_col: str = "id",
                         replicates: int = 1000, seed: int = 42, evaluator: str = "auroc",
                         tolerance: float = 1e-12) -> DataFrame:
    """Approximate randomisation test of metric(system) - metric(baseline) on one gold set.

    Replicate 0 is the observed pairing; in replicate r each row swaps its two scores when its digit of a hash of
    (seed, block of r, id) says so. p = (1 + #{r : |Δr| >= |Δ0|}) / (1 + R), two-sided. Rows are expanded
    R + 1 times, but every metric collapses them to distinct (replicate, system, score) first.
    """
    base = df.select(F.col(id_col).alias("__id"), F.col(label).alias("label"),
                     F.col(system).alias("__a"), F.col(baseline).alias("__b"))
    # one md5 a row and block of replicates: hex digit j is 0-7, i.e. its top bit is 0, with probability 1/2
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__block").cast("string"), F.col("__id").cast("string")))
    first = F.col("__block") * SWAPS + 1
    drawn = base.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // SWAPS))))).withColumn("__md5", digest) \
        .withColumn("replicate", F.explode(F.when(F.col("__block") * SWAPS < replicates, F.sequence(first, F.least(first + SWAPS - 1, F.lit(replicates))))
                                           .otherwise(F.array(F.lit(0)))))  # the block after the last stands for the observed pairing
    rep = drawn.select("replicate", "label", "__a", "__b", F.substring(
        F.col("__md5"), F.pmod(F.col("replicate") - 1, F.lit(SWAPS)) + 1, F.lit(1)).alias("__digit"))
    swap = (F.col("replicate") > 0) & (F.col("__a") != F.col("__b")) & (F.col("__digit") < F.lit("8"))
    both = rep.select("replicate", "label", F.explode(F.array(
        F.struct(F.lit("system").alias("system"), F.when(swap, F.col("__b")).otherwise(F.col("__a")).alias("score")),
        F.struct(F.lit("baseline").alias("system"), F.when(swap, F.col("__a")).otherwise(F.col("__b")).alias("score"))
    )).alias("__s")).select("replicate", "label", "__s.system", "__s.score")
    m = evaluate(both, ["replicate", "system"], evaluator, n_keys=(replicates + 1) * 2)
    d = (m.groupBy("replicate")
         .agg(F.max(F.when(F.col("system") == "system", F.col("value"))).alias("__sys"),
              F.max(F.when(F.col("system") == "baseline", F.col("value"))).alias("__base"))
         .withColumn("__delta", F.col("__sys") - F.col("__base")))
    # d has R + 1 rows (bounded by the parameter): one window over it brings the observed delta to every
    # replicate, so d is consumed once and the expanded rows are aggregated once.
    whole = Window.partitionBy()
    obs_of = lambda c: F.max(F.when(F.col("replicate") == 0, F.col(c))).over(whole)
    d = d.select("replicate", "__delta", obs_of("__sys").alias("metric_system"),
                 obs_of("__base").alias("metric_baseline"), obs_of("__delta").alias("delta"))
    hit = (F.col("replicate") > 0) & (F.abs(F.col("__delta")) >= F.abs(F.col("delta")) - F.lit(tolerance))
    out = d.groupBy("metric_system", "metric_baseline", "delta").agg(
        F.sum(F.when(hit, 1).otherwise(0)).cast("long").alias("hits"))
    return out.select("metric_system", "metric_baseline", "delta",
                      ((F.col("hits") + F.lit(1)).cast("double") / F.lit(float(replicates + 1))).alias("p_value"),
                      F.lit(replicates).cast("long").alias("replicates"))


def predictions_wide(long: DataFrame, splits: Sequence[int], key: str = "id", split: str = "split",
                     score: str = "score") -> DataFrame:
    """Long (id, split, score) -> one column ``split<i>`` per split, keyed by id (known pivot values: one pass)."""
    w = long.groupBy(key).pivot(split, list(splits)).agg(F.first(F.col(score)))
    return w.select(key, *[F.col(str(s)).alias(f"split{s}") for s in splits])
