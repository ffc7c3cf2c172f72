"""Matrix factorisation by stochastic gradient descent: W (K x users' dimension), H (K x items' dimension), as blocks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.columns import dot
from keyloom.operators.array import DistArray
from keyloom.operators.loops import Blocks, parallel_for
from keyloom.plans.meta import Meta


def ratings(spark: SparkSession, sf_dir: str) -> DistArray:
    """Average quantity of each part and supplier, at (part + 1, supplier + 1)."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy((F.col("l_partkey") + 1).alias("k1"), (F.col("l_suppkey") + 1).alias("k2"))
    return DistArray(rows.agg(F.avg("l_quantity").alias("value")), Meta(2))


def wave_factors(spark: SparkSession, n: int, rank: int, phase: float) -> Blocks:
    """Factors in closed form: sin(phase + f * k) / 10 at row f of coordinate k."""
    vec = F.transform(F.sequence(F.lit(1), F.lit(rank)), lambda f: F.sin(F.lit(phase) + f * F.col("k")) / 10)
    return Blocks(spark.range(1, n + 1).select(F.col("id").alias("k")).withColumn("vec", vec), n)


def random_factors(spark: SparkSession, n: int, rank: int, seed: int) -> Blocks:
    """Normal factors over ten, from the coordinate's hash: the same wherever they are drawn."""
    u = lambda f, s: (F.pmod(F.xxhash64(F.lit(seed), F.col("k"), f, F.lit(s)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    normal = lambda f: F.sqrt(-2 * F.log(u(f, 0))) * F.cos(2 * math.pi * u(f, 1)) / 10
    return Blocks(spark.range(1, n + 1).select(F.col("id").alias("k")).withColumn("vec", F.transform(F.sequence(F.lit(1), F.lit(rank)), normal)), n)


def squared_error(r: DistArray, w: Blocks, h: Blocks) -> DataFrame:
    """loss: the sum over ratings of (r - w.h)^2. No dependence: two joins and one aggregate."""
    joined = r.df.join(w.df.select(F.col("k").alias("k1"), F.col("vec").alias("w")), "k1").join(h.df.select(F.col("k").alias("k2"), F.col("vec").alias("h")), "k2")
    error = F.col("value") - dot(F.col("w"), F.col("h"))
    return joined.agg(F.sum(error * error).alias("loss"), F.count(F.lit(1)).alias("n"))


def sgd_body(step: float):
    def body(key, value, W, H):
        w = W[:, key[0]]
        h = H[:, key[1]]
        d = value - np.vecdot(w, h, axis=0)
        W[:, key[0]] = w + 2 * step * d * h
        H[:, key[1]] = h + 2 * step * d * w

    body.together = True
    return body


def adaptive_body(alpha: float):
    """Step sizes fall with the gradients' squares, kept per factor in W_z and H_z."""

    def body(key, value, W, H, W_z, H_z):
        w = W[:, key[0]]
        h = H[:, key[1]]
        d = value - np.vecdot(w, h, axis=0)
        gw = -2 * d * h
        gh = -2 * d * w
        W_z[:, key[0]] = W_z[:, key[0]] + gw * gw
        H_z[:, key[1]] = H_z[:, key[1]] + gh * gh
        W[:, key[0]] = w - alpha / np.sqrt(W_z[:, key[0]]) * gw
        H[:, key[1]] = h - alpha / np.sqrt(H_z[:, key[1]]) * gh

    body.together = True
    return body


def epoch(r: DistArray, w: Blocks, h: Blocks, step: float = 0.01, ordered: bool = False, slots: int | None = None) -> tuple[Blocks, Blocks]:
    out, _ = parallel_for(r, sgd_body(step), {"W": w, "H": h}, ordered=ordered, slots=slots)
    return out["W"], out["H"]


def ones_like(b: Blocks) -> Blocks:
    return Blocks(b.df.withColumn("vec", F.transform("vec", lambda _: F.lit(1.0))), b.size)


def adaptive_epoch(r: DistArray, w: Blocks, h: Blocks, w_z: Blocks | None = None, h_z: Blocks | None = None, alpha: float = 0.08, ordered: bool = False, slots: int | None = None) -> tuple[Blocks, ...]:
    arrays = {"W": w, "H": h, "W_z": w_z or ones_like(w), "H_z": h_z or ones_like(h)}
    out, _ = parallel_for(r, adaptive_body(alpha), arrays, ordered=ordered, slots=slots)
    return out["W"], out["H"], out["W_z"], out["H_z"]
