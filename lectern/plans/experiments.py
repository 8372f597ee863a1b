"""Experiment grids over config rows: run what has no finished output yet, compare, promote."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

ITEM_CF_GRID = [{"name": "likes4", "threshold": 4}, {"name": "likes5", "threshold": 5}]


def als_grid(base: dict | None = None, iterations: Iterable[int] = (), features: Iterable[int] = (), regs: Iterable[float] = ()) -> list[dict]:
    """One config per swept value around a base."""
    base = {"k": 64, "reg": 0.1, "iterations": 15} | (base or {})
    sweeps = [("iterations", iterations), ("k", features), ("reg", regs)]
    return [base | {key: v, "name": f"{key}_{v:g}"} for key, values in sweeps for v in values]


def run_grid(spark: SparkSession, out: str, configs: list[dict], run: Callable[[dict], DataFrame], *, stop_on_failure: bool = True) -> DataFrame:
    """Metrics of every config; a config whose output is finished is not run again.

    run(config) returns a one-row DataFrame of metrics.
    """
    failed = []
    for config in configs:
        path = f"{out}/{config['name']}"
        if files.exists(spark, path):
            continue
        try:
            run(config).withColumn("name", F.lit(config["name"])).coalesce(1).write.mode("overwrite").parquet(path)
        except Exception as problem:
            if stop_on_failure:
                raise
            failed.append((config["name"], str(problem)[:200]))
    done = [f"{out}/{c['name']}" for c in configs if files.exists(spark, f"{out}/{c['name']}")]
    if not done:
        raise RuntimeError(f"no config finished: {failed}")
    return spark.read.parquet(*done)


def best(results: DataFrame, metric: str = "mrr_at_50") -> str:
    """Name of the best config, ties by name."""
    return results.orderBy(F.col(metric).desc(), "name").first()["name"]
