"""Bootstrap intervals and rank statistics.

A resample is a table of multiplicities (replicate, id, w), drawn once by a
stateless rule and joined to every cell that shares it.  Draws of a replicate
never meet rows of another, so replicates spread over the cluster.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .. import constants as K
from ..functions.draws import draw
from .common import below, broadcast_if_small, numbered_values, ranked, ranked_by_digest

BOUNDS = (0.025, 0.975)
DRAWN_TOGETHER = 100  # blocks of replicates; a task draws whole blocks


def replicates(spark: SparkSession, n_boot: int = K.BOOT_REPLICATES) -> DataFrame:
    return spark.range(n_boot).select(F.col("id").alias("replicate"))


def weights(clusters: DataFrame, key: str, stratum: str | None = None, n_boot: int = K.BOOT_REPLICATES, seed: int = K.SEED_PROFILE, purpose: str = "") -> DataFrame:
    """(replicate, key, w): how often each id is drawn, within strata of their own sizes.

    Ids are numbered in each stratum by key, null last; slot s of a replicate draws the
    number md5("seed:purpose:stratum:replicate:slot") mod n.
    """
    s = F.col(stratum) if stratum else F.lit("all")
    ids = clusters.select(F.col(key).alias("_id"), s.cast("string").alias("_s")).distinct()
    w = Window.partitionBy("_s")
    ids = ids.withColumn("_i", F.row_number().over(w.orderBy(F.col("_id").asc_nulls_last())) - 1).withColumn("_n", F.count("*").over(w))
    blocks = min(DRAWN_TOGETHER, n_boot)
    parts = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = ids.select("_s", F.col("_i").alias("slot"), "_n", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")).repartition(parts, "_block")
    draws = slots.withColumn("replicate", F.explode(F.sequence(F.col("_block"), F.lit(n_boot - 1), F.lit(blocks))))
    picks = draws.select("_block", "replicate", "_s", draw(F.col("_n"), seed, purpose, F.col("_s"), F.col("replicate"), F.col("slot")).alias("_i"))
    counted = picks.groupBy("_block", "replicate", "_s", "_i").agg(F.count("*").alias("w"))  # where they were drawn
    return counted.join(ids.select("_s", "_i", "_id"), ["_s", "_i"]).select("replicate", F.col("_id").alias(key), "w")


def interval(values: Column) -> list[Column]:
    p = F.percentile(values, F.array(*map(F.lit, BOUNDS)))
    return [p[0].alias("ci_lo"), p[1].alias("ci_hi")]


def mean_interval(cells: DataFrame, w: DataFrame, key: str, value: str, *facet: str) -> DataFrame:
    """Mean over ids with its bootstrap interval; null values are left out of both."""
    rows = cells.where(F.col(value).isNotNull())
    boot = rows.join(w, key).groupBy("replicate", *facet).agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias("m"))
    point = rows.groupBy(*facet).agg(F.avg(value).alias("point"), F.count("*").alias("n"))
    ci = boot.groupBy(*facet).agg(*interval(F.col("m")))
    return point.join(ci, list(facet)) if facet else point.crossJoin(ci)


def ratio_interval(cells: DataFrame, w: DataFrame, key: str, num: str, den: str) -> DataFrame:
    """Pooled ratio with its cluster bootstrap interval; replicates without a denominator are left out."""
    boot = cells.join(w, key).groupBy("replicate").agg(F.sum(F.col(num) * F.col("w")).alias("n"), F.sum(F.col(den) * F.col("w")).alias("d")).where("d <> 0")
    point = cells.agg((F.sum(num) / F.nullif(F.sum(den), F.lit(0.0))).alias("point"), F.count("*").alias("n_clusters"))
    return point.crossJoin(boot.agg(*interval(F.col("n") / F.col("d"))))


def paired_delta(a: DataFrame, b: DataFrame, w: DataFrame, key: str, value: str, n_boot: int = K.BOOT_REPLICATES, scale: float = 100.0) -> DataFrame:
    """Mean of (a - b) over the ids of w, times scale: interval, two-sided p of at least 1 / n_boot, and whether 0 is outside.

    An id that a cell lacks makes the contrast null.
    """
    ids = w.select(key).distinct()
    diff = ids.join(a.select(key, F.col(value).alias("_a")), key, "left").join(b.select(key, F.col(value).alias("_b")), key, "left").withColumn("d", (F.col("_a") - F.col("_b")) * scale)
    point = diff.agg(F.avg("d").alias("delta"), F.count_if(F.col("d").isNull()).alias("n_missing"), F.count("*").alias("n"))
    boot = diff.join(w, key).groupBy("replicate").agg((F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("m"))
    p = 2 * F.least(F.avg((F.col("m") <= 0).cast("int")), F.avg((F.col("m") >= 0).cast("int")))
    out = point.crossJoin(boot.agg(*interval(F.col("m")), F.least(F.greatest(p, F.lit(1 / n_boot)), F.lit(1.0)).alias("p")))
    whole = F.col("n_missing") == 0
    for c in ("delta", "ci_lo", "ci_hi", "p"):
        out = out.withColumn(c, F.when(whole, F.col(c)))
    return out.withColumn("resolved", F.when(whole, (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)))


def two_sample(a: DataFrame, b: DataFrame, key: str, value: str, n_boot: int = K.BOOT_REPLICATES, seed: int = K.SEED_PROFILE) -> DataFrame:
    """Difference of two unpaired means, each side drawn from a stream of its own."""
    sides = []
    for name, side in (("a", a), ("b", b)):
        side = side.where(F.col(value).isNotNull())
        w = weights(side, key, n_boot=n_boot, seed=seed, purpose=name)
        sides.append(side.join(w, key).groupBy("replicate").agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias(name)))
    boot = sides[0].join(sides[1], "replicate")
    point = a.agg(F.avg(value).alias("_a")).crossJoin(b.agg(F.avg(value).alias("_b"))).select((F.col("_a") - F.col("_b")).alias("point"))
    return point.crossJoin(boot.agg(*interval(F.col("a") - F.col("b"))))


def holm(tests: DataFrame, name: str, p: str, alpha: float = 0.05, family: str | None = None) -> DataFrame:
    """Step-down adjusted p: the running maximum of (m - k) p in the order of p, at most 1."""
    w = Window.partitionBy(*([family] if family else []))
    order = w.orderBy(p, name)
    raw = (F.count("*").over(w) - F.row_number().over(order) + 1) * F.col(p)
    stepped = tests.withColumn("_raw", raw).withColumn("p_holm", F.least(F.lit(1.0), F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_raw")
    return stepped.withColumn("rejected", F.col("p_holm") <= alpha)


def auroc(scores: DataFrame, score: str, label: Column, *facet: str, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve from (weighted) average ranks; null if a class is empty.

    Equal scores are summed first, so the window runs over different scores
    and not over rows.
    """
    w = F.col(weight) if weight else F.lit(1)
    tie = scores.groupBy(*facet, score).agg(F.sum(F.when(label, w).otherwise(0)).alias("pos"), F.sum(F.when(label, 0).otherwise(w)).alias("neg"))
    win = Window.partitionBy(*facet).orderBy(score)
    below = F.coalesce(F.sum("neg").over(win.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = tie.withColumn("_u", F.col("pos") * (below + F.col("neg") / 2))
    return got.groupBy(*facet).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.try_divide(F.sum("_u"), F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auroc"))


PIECE = 1 << 14  # cells of a task, about
BLOCKS = 16  # of replicates, each a task of its own for every piece
WHOLE = -1  # stands for a replicate that takes every row once


def _pieces(cells: DataFrame, score: str, key: str) -> DataFrame:
    """cells with `_range` and `_part`: ranges of scores between quantiles, a score that fills whole ranges cut by the key, null scores apart."""
    n = max(1, -(-cells.count() // PIECE))
    x, part = F.col(score).cast("double"), F.xxhash64(key)
    found = cells.agg(F.percentile_approx(x, [i / n for i in range(1, n)], 10_000).alias("cuts")).first().cuts if n > 1 else None
    times = Counter(found or [])
    cuts = sorted(times)
    fills = F.get(F.array(*(F.lit(times[c]) for c in cuts)).cast("array<int>"), F.col("_range"))
    bound = F.get(F.array(*map(F.lit, cuts)).cast("array<double>"), F.col("_range"))
    placed = cells.withColumn("_range", F.when(x.isNull(), -1).otherwise(below(cuts, x)))
    return placed.withColumn("_part", F.when(x.isNull(), F.pmod(part, F.lit(n))).when(bound == x, F.pmod(part, fills)).otherwise(0))


def _piece_sums(s: np.ndarray, c: np.ndarray, pos: np.ndarray, neg: np.ndarray, w: np.ndarray) -> list[tuple]:
    """(score, between, positives, negatives, pairs won), by row of w, for the cells of a piece: of its least score, of its greatest, and of what lies between.

    s numbers the piece's scores from 0, c the columns of w, which has a row
    of weights for each replicate.  Pairs are counted only between the least
    and the greatest score, as other pieces may have those two.  With few ids
    they come from the pairs won by every id from every other, else from
    running sums of each replicate.  All are sums of whole and half numbers,
    exact below 2**53.
    """
    n, ids = int(s.max()) + 1, w.shape[1]
    if ids * ids <= len(s):
        p, q = (np.bincount(s * ids + c, x, n * ids).reshape(n, ids) for x in (pos, neg))
        mid_p, mid_q = p[1:-1], q[1:-1]
        won = mid_p.T @ (np.cumsum(mid_q, 0) - mid_q / 2)
        sums = [(w @ p[0], w @ q[0], w @ p[-1], w @ q[-1], w @ mid_p.sum(0), w @ mid_q.sum(0), ((w @ won) * w).sum(1))]
    else:
        order = np.argsort(s, kind="stable")
        c, pos, neg, starts = c[order], pos[order], neg[order], np.searchsorted(s[order], np.arange(n))
        sums, step = [], max(1, (1 << 19) // len(s))
        for lo in range(0, len(w), step):
            own = w[lo : lo + step, c]
            p, q = np.add.reduceat(own * pos, starts, 1), np.add.reduceat(own * neg, starts, 1)
            mid_p, mid_q = p[:, 1:-1], q[:, 1:-1]
            sums.append((p[:, 0], q[:, 0], p[:, -1], q[:, -1], mid_p.sum(1), mid_q.sum(1), (mid_p * (np.cumsum(mid_q, 1) - mid_q / 2)).sum(1)))
    p0, q0, p2, q2, p1, q1, u1 = map(np.concatenate, zip(*sums, strict=True))
    return [(0, False, p0, q0, 0 * p0), (n - 1, False, p2, q2, 0 * p2), (0, True, p1, q1, u1)][: min(n, 3)]


def _block_sums(key: tuple, cells: pa.Table, drawn: pa.Table) -> pa.Table:
    """The sums of a piece for a block of replicates; the first block's have those of all rows too."""
    block, scores, lists = key[2].as_py(), cells["_score"].combine_chunks(), drawn["_drawn"].combine_chunks()
    own = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)) if len(lists) else np.empty(0, int)
    pairs = lists.flatten()
    replicates, row = np.unique(pairs.field("replicate").to_numpy(), return_inverse=True)
    w = np.zeros((len(replicates) + (block == 0), len(lists) + 1))  # the last column: ids that are not drawn
    np.add.at(w, (row, own), pairs.field("w").to_numpy())
    if block == 0:
        replicates, w[-1] = np.append(replicates, WHOLE), 1
    c = pc.index_in(cells["_id"], drawn["_id"]).fill_null(len(lists)).to_numpy()
    s = np.zeros(len(scores), int)
    if scores.null_count == 0:
        scores, s = np.unique(scores.to_numpy(), return_inverse=True)
    got = _piece_sums(s, c, *(cells[x].to_numpy().astype(float) for x in ("_pos", "_neg")), w)
    kind, n = cells.schema.field("_score").type, len(replicates)
    parts = [pa.table({"replicate": replicates.astype("int64"), "_at": pa.array([scores[i]] * n, kind), "_between": pa.array([between] * n, pa.bool_()), "_p": p, "_q": q, "_u": u}) for i, between, p, q, u in got]
    return pa.concat_tables(parts)


def auroc_interval(scores: DataFrame, w: DataFrame, key: str, score: str, label: Column) -> DataFrame:
    """Clustered bootstrap of the AUROC: all rows of a drawn cluster, as often as it is drawn.

    Rows shrink to counts of equal (score, key), these are dealt to pieces by
    ranges of scores, and a piece meets the weights of its own ids in blocks
    of replicates.  Each gives a few sums a replicate, from which the pairs
    between pieces follow, so no rows are made for replicates times scores, only
    the weights' for replicates times ids.
    Null scores are the greatest, null labels count for neither class.
    """
    cells = scores.groupBy(F.col(score).alias("_score"), F.col(key).alias("_id")).agg(F.count_if(label).alias("_pos"), F.count_if(~label).alias("_neg"))
    cells = _pieces(cells, "_score", "_id")
    drawn = w.groupBy(F.col(key).alias("_id"), F.pmod("replicate", F.lit(BLOCKS)).cast("int").alias("_in_block")).agg(F.collect_list(F.struct("replicate", "w")).alias("_drawn"))
    drawn = drawn.join(cells.select(F.col("_range").alias("_in_range"), F.col("_part").alias("_in_part"), F.col("_id").alias("_id")).distinct(), "_id")
    blocks = cells.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    kind = scores.schema[score].dataType.simpleString()
    sums = blocks.groupBy("_range", "_part", "_block").cogroup(drawn.groupBy("_in_range", "_in_part", "_in_block")).applyInArrow(_block_sums, f"replicate long, _at {kind}, _between boolean, _p double, _q double, _u double")
    own, order = Window.partitionBy("replicate"), [F.col("_at").asc_nulls_last(), F.col("_between")]
    upto, here = F.sum("_q").over(own.orderBy(*order)), F.sum("_q").over(Window.partitionBy("replicate", "_at", "_between"))
    sums = sums.withColumn("_u", F.col("_u") + F.col("_p") * (upto - F.when(F.col("_between"), here).otherwise(here / 2)))
    area = F.try_divide(F.sum("_u"), F.nullif(F.sum("_p") * F.sum("_q"), F.lit(0.0)))
    each = sums.groupBy("replicate").agg(F.sum("_p").alias("_p"), F.sum("_q").alias("_q"), area.alias("_area"))
    whole = F.col("replicate") == WHOLE
    point = [F.max(F.when(whole, F.col(c))).cast(t).alias(name) for c, t, name in (("_p", "long", "n_pos"), ("_q", "long", "n_neg"), ("_area", "double", "auroc"))]
    area = F.when(~whole, F.col("_area"))
    return each.agg(*point, *interval(area), F.count(area).alias("n_replicates"))


def spearman(df: DataFrame, a: str, b: str, key: str, *facet: str) -> DataFrame:
    """Correlation of ordinal ranks, equal values ranked by key."""
    base = numbered_values(numbered_values(df.select(*facet, a, b, key), a, "_x"), b, "_y")
    ranks = ranked(base, F.col("_x"), F.col(key), name="_a", within=facet)
    ranks = ranked(ranks, F.col("_y"), F.col(key), name="_b", within=facet, measured=base)
    return ranks.groupBy(*facet).agg(F.corr("_a", "_b").alias("rho"), F.count("*").alias("n"))


def average_rank(df: DataFrame, value: str, *facet: str) -> DataFrame:
    """df with ranks from 1, equal values getting the mean of their ranks; the window runs over different values and not over rows."""
    ties = df.groupBy(*facet, value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*facet).orderBy(value))
    own = [F.col(c).alias(f"_of_{c}") for c in (*facet, value)]
    ties = ties.select(*own, (upto - (F.col("_n") - 1) / 2).alias("avg_rank"))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*facet, value)))
    return df.join(broadcast_if_small(ties), same).drop(*(f"_of_{c}" for c in (*facet, value)))


def external_interval(counts: DataFrame, n_boot: int = K.BOOT_REPLICATES, seed: int = K.SEED_EXTERNAL, per: int = 12) -> DataFrame:
    """Paired difference of correct counts (problem_id, a, b) in percent, with order-statistic bounds and no interpolation."""
    d = counts.select("problem_id", ((F.col("a") - F.col("b")) * 100.0 / per).alias("d"))
    w = weights(d, "problem_id", n_boot=n_boot, seed=seed, purpose="external")
    boot = d.join(w, "problem_id").groupBy("replicate").agg((F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("m"))
    at = boot.agg(F.sort_array(F.collect_list("m")).alias("s"))  # n_boot numbers
    lo, hi = int(0.025 * n_boot), int(0.975 * n_boot) - 1
    return d.agg(F.avg("d").alias("point")).crossJoin(at.select(F.element_at("s", lo + 1).alias("ci_lo"), F.element_at("s", hi + 1).alias("ci_hi")))


def seed_aware(cells: DataFrame, key: str = "problem_id", value: str = "value", seed: str = "seed") -> DataFrame:
    """Mean over seeds of each problem that every seed scored."""
    n = cells.agg(F.countDistinct(seed).alias("_seeds"))
    got = cells.groupBy(key).agg(F.avg(value).alias(value), F.countDistinct(seed).alias("_n"))
    return got.crossJoin(F.broadcast(n)).where(F.col("_n") == F.col("_seeds")).select(key, value)


def _t_half(p: float):
    from ..functions.student_t import quantile

    @F.pandas_udf("double")
    def t(df: pd.Series) -> pd.Series:
        return df.map(lambda x: quantile(p, x) if x and x > 0 else None)

    return t


def seed_interval(values: DataFrame, value: str, *group: str, conf: float = 0.95) -> DataFrame:
    """Mean over seeds with a Student interval; no interval for a single seed."""
    s = values.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = F.when(F.col("n") > 1, _t_half(0.5 + conf / 2)((F.col("n") - 1).cast("double")) * F.col("sd") / F.sqrt("n"))
    return s.withColumn("half_width", half)


def welch(values: DataFrame, value: str, side: str, conf: float = 0.95) -> DataFrame:
    """Difference of the means of sides a and b with Welch's interval."""
    parts = []
    for s in ("a", "b"):
        x = F.when(F.col(side) == s, F.col(value))
        parts += [F.count(x).alias(f"n_{s}"), F.avg(x).alias(f"m_{s}"), F.var_samp(x).alias(f"v_{s}")]
    r = values.agg(*parts)
    va, vb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    df = (va + vb) ** 2 / (va**2 / (F.col("n_a") - 1) + vb**2 / (F.col("n_b") - 1))
    r = r.withColumn("delta", F.col("m_a") - F.col("m_b")).withColumn("df", df)
    return r.withColumn("half_width", _t_half(0.5 + conf / 2)(F.col("df")) * F.sqrt(va + vb)).select("delta", "df", "half_width")


# The ridge of both coefficients, rounds, the least step, and the bound of the log-odds.
RIDGE, ROUNDS, LEAST_STEP, MOST_LOGIT = 1.0, 25, 1e-10, 30.0


def _odds(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(F.col("_b0") + F.col("_b1") * z, F.lit(-MOST_LOGIT)), F.lit(MOST_LOGIT))))


def out_of_fold(rows: DataFrame, feature: str, label: str, cluster: str, group: str, folds: int = 8, seed: int = K.SEED_PROFILE) -> DataFrame:
    """rows with `fold` and `predicted`: a ridge logistic fit on the other folds, all rows of a cluster sharing a fold.

    Rows without the feature are left out; `predicted` is null where a group
    has no other fold.  Rows shrink to counts of equal (group, fold, feature,
    label); every Newton step of all fits together is one aggregation of
    these, so no task holds a group.  The driver keeps two coefficients for
    each group and fold.
    """
    ids = rows.select(F.col(group).alias("_g"), F.col(cluster).alias("_c")).distinct()
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_c").cast("string")).cast("binary"))
    ids = ranked_by_digest(ids, order, F.col("_c"), name="_i", within=("_g",)).select("_g", "_c", (F.col("_i") % folds).cast("int").alias("fold"))
    data = rows.where(F.col(feature).isNotNull()).join(ids, F.col(group).eqNullSafe(F.col("_g")) & F.col(cluster).eqNullSafe(F.col("_c"))).drop("_g", "_c")
    x, y, n = F.col(feature).cast("double").alias("_x"), F.col(label).cast("double").alias("_y"), F.count("*").alias("_n")
    cells = data.groupBy(F.col(group).alias("_g"), "fold", x, y).agg(n).persist()
    others = cells.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("_k <> fold")
    fits = others.groupBy("_g", "_k").agg((F.sum(F.col("_x") * F.col("_n")) / F.sum("_n")).alias("_mean"))
    apart = others.withColumnsRenamed({"_g": "_h", "_k": "_l"}).join(F.broadcast(fits), F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_k") == F.col("_l")))
    spread = F.sqrt(F.sum((F.col("_x") - F.col("_mean")) ** 2 * F.col("_n")) / F.sum("_n"))
    state = {(r._g, r._k): [r._mean, r.sd if r.sd >= 1e-12 else 1.0, 0.0, 0.0] for r in apart.groupBy("_g", "_k", "_mean").agg(spread.alias("sd")).collect()}
    schema = StructType([StructField("_g", rows.schema[group].dataType), StructField("_k", IntegerType()), *(StructField(c, DoubleType()) for c in ("_mean", "_sd", "_b0", "_b1"))])

    def fitted(keys) -> DataFrame:
        return F.broadcast(rows.sparkSession.createDataFrame([(*k, *state[k]) for k in keys], schema))

    z = (F.col("_x") - F.col("_mean")) / F.col("_sd")
    moving = list(state)
    for _ in range(ROUNDS):
        if not moving:
            break
        on = others.withColumnsRenamed({"_g": "_h", "_k": "_l"}).join(fitted(moving), F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_k") == F.col("_l")))
        on = on.select("_g", "_k", "_n", z.alias("z"), _odds(z).alias("p"), "_y").withColumn("w", F.col("_n") * F.col("p") * (1 - F.col("p"))).withColumn("e", F.col("_n") * (F.col("_y") - F.col("p")))
        sums = on.groupBy("_g", "_k").agg(F.sum("w").alias("a"), F.sum(F.col("w") * F.col("z")).alias("b"), F.sum(F.col("w") * F.col("z") ** 2).alias("c"), F.sum("e").alias("d"), F.sum(F.col("e") * F.col("z")).alias("f"))
        moving = []
        for r in sums.collect():  # a row for each group and fold
            own = state[r._g, r._k]
            a, c, d, f = r.a + RIDGE, r.c + RIDGE, r.d - RIDGE * own[2], r.f - RIDGE * own[3]
            det = a * c - r.b * r.b
            step = (c * d - r.b * f) / det, (a * f - r.b * d) / det
            own[2], own[3] = own[2] + step[0], own[3] + step[1]
            if max(map(abs, step)) >= LEAST_STEP:
                moving.append((r._g, r._k))
    cells.unpersist()
    z = (F.col(feature).cast("double") - F.col("_mean")) / F.col("_sd")
    with_fits = data.join(fitted(state), F.col(group).eqNullSafe(F.col("_g")) & (F.col("fold") == F.col("_k")), "left")
    return with_fits.withColumn("predicted", F.when(z.isNotNull(), _odds(z))).drop("_g", "_k", "_mean", "_sd", "_b0", "_b1")


def win_table(aurocs: DataFrame, view: str = "view", feature: str = "feature") -> DataFrame:
    """A row for each view, a column for each feature, and the feature that beats all others, if one does."""
    top = aurocs.withColumn("_m", F.max("auroc").over(Window.partitionBy(view)))
    best = top.groupBy(view).agg(F.max_by(feature, "auroc").alias("best"), F.count_if(F.col("auroc") == F.col("_m")).alias("n_best"))
    return aurocs.groupBy(view).pivot(feature).agg(F.first("auroc")).join(best, view)
