"""Logistic regression over sparse features: exact gradient epochs, mini-batches and AdaRevision, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.columns import safe_log, sigmoid
from keyloom.operators.array import DistArray
from keyloom.operators.buffers import WriteBuffer, numbered
from keyloom.plans.meta import DelayMode, Meta
from keyloom.plans.storage import dropped, kept


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exploded samples: id (1-based), y, fid (1-based), fval."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("vec_id") + 1).alias("id"), (F.col("label") >= 5).cast("int").alias("y"), F.posexplode("embedding").alias("p", "v"))
    return rows.select("id", "y", (F.col("p") + 1).cast("long").alias("fid"), F.col("v").cast("double").alias("fval"))


def constant_weights(spark: SparkSession, features: int, value: Column) -> DistArray:
    """``value`` may use ``k1``."""
    return DistArray(spark.range(1, features + 1).select(F.col("id").alias("k1")).withColumn("value", value), Meta(1, (features,), True))


def scored(x: DataFrame, w: DistArray) -> DataFrame:
    """id, y, s: each sample's sum of weight times feature."""
    return x.join(w.df.select(F.col("k1").alias("fid"), F.col("value").alias("w")), "fid").groupBy("id", "y").agg(F.sum(F.col("fval") * F.col("w")).alias("s"))


def gradients(x: DataFrame, w: DistArray) -> DataFrame:
    """k1, g per sample and feature: fval * (sigmoid(s) - y)."""
    return x.join(scored(x, w).drop("y"), "id").select("id", F.col("fid").alias("k1"), (F.col("fval") * (sigmoid(F.col("s")) - F.col("y"))).alias("g"))


def epoch(x: DataFrame, w: DistArray, step: float) -> DistArray:
    """One full-batch step: updates go through a write buffer that is flushed once."""
    buffer = WriteBuffer(F.sum)
    updates = gradients(x, w).select("k1", (-step * F.col("g")).alias("update"))
    return buffer.flush(w, buffer.delta(updates, ["k1"]))


def minibatch_epoch(x: DataFrame, w: DistArray, step: float, max_delay: int) -> DistArray:
    """As ``epoch``, flushed after every ``max_delay`` samples in the order of ids. Batches are driven one by one."""
    ids = kept(numbered(x.select("id").distinct(), ["id"]).withColumn("b", F.expr(f"_at div {int(max_delay)}")), "ids")
    x = kept(x.join(ids.select("id", "b"), "id"), "samples", by="b")
    last, before = ids.agg(F.max("b")).first()[0], None
    for b in range(0 if last is None else last + 1):
        w = w.with_df(kept(epoch(x.where(F.col("b") == b).drop("b"), w, step).df, "weights"))  # one batch's folder is read
        dropped(*[] if before is None else [before])
        before = w.df
    dropped(ids, x)
    return w


def metrics(x: DataFrame, w: DistArray) -> DataFrame:
    """loss (log-loss), err (squared error), misses, n."""
    p = scored(x, w).withColumn("p", sigmoid(F.col("s")))
    loss = F.when(F.col("y") == 1, -safe_log(F.col("p"))).otherwise(-safe_log(1 - F.col("p")))
    error = F.col("p") - F.col("y")
    return p.agg(F.sum(loss).alias("loss"), F.sum(error * error).alias("err"), F.sum(((F.col("p") >= 0.5).cast("int") != F.col("y")).cast("long")).alias("misses"), F.count(F.lit(1)).alias("n"))


def adarevision_state(w: DistArray) -> dict[str, DistArray]:
    """The weights and three helpers: accumulated gradients 0, z 1, largest z 1."""
    like = lambda value: w.with_df(w.df.withColumn("value", F.lit(value)))
    return {"x": w, "G": like(0.0), "z": like(1.0), "zp": like(1.0)}


def adarevision_apply(alpha: float):
    """New (x, G, z, zp) from a step's gradient and the accumulated gradient that it was computed from."""

    def apply(keys, x, update, G, z, zp):
        g, old = update["g"], update["old"]
        back = G - old
        eta_old = alpha / F.sqrt(zp)
        z2 = z + g * g + 2 * g * back
        zp2 = F.greatest(z2, zp)
        eta = alpha / F.sqrt(zp2)
        return x - eta * g + (eta_old - eta) * back, G + g, z2, zp2

    return apply


def adarevision_step(state: dict[str, DistArray], grads: DataFrame, seen: DistArray, alpha: float) -> dict[str, DistArray]:
    """Applies gradients (k1, g) computed when the accumulated gradient was ``seen``. Gradients add up; ``seen`` is read once a key."""
    buffer = WriteBuffer(F.sum, adarevision_apply(alpha), DelayMode.DEFAULT)
    summed = grads.groupBy("k1").agg(F.sum("g").alias("g")).join(seen.df.withColumnRenamed("value", "old"), "k1")
    delta = summed.select("k1", F.struct("g", "old").alias("update"))
    x, g, z, zp = buffer.flush(state["x"], delta, (state["G"], state["z"], state["zp"]))
    return {"x": x, "G": g, "z": z, "zp": zp}


def adarevision_epoch(x: DataFrame, state: dict[str, DistArray], alpha: float = 0.1, batches: int = 1) -> dict[str, DistArray]:
    """Gradients of ``batches`` parts of the samples, all computed from the state at the start and applied one after another.

    So those of later parts come late by what earlier ones have added, which the revision takes into account.
    """
    seen, grads = state["G"], gradients(x, state["x"])
    if batches > 1:
        grads = kept(grads.groupBy(F.pmod("id", F.lit(batches)).alias("part"), "k1").agg(F.sum("g").alias("g")), "gradients")
    for part in range(batches):
        now = grads.where(F.col("part") == part) if batches > 1 else grads
        state = adarevision_step(state, now.select("k1", "g"), seen, alpha)
    return state
