"""Stores on disk as a versioned folder of Parquet tables, and experiment files."""

from __future__ import annotations

import hashlib
import json
import platform
import subprocess
import sys
from importlib import metadata
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import SCHEMA_VERSION, FactorStore

TABLES = ("left", "right", "temporal")


def save_store(store: FactorStore, path: str) -> None:
    """Factor tables, residuals partitioned by step, node bounds, and one row of metadata, written last."""
    for name in TABLES:
        getattr(store, name).write.mode("overwrite").parquet(f"{path}/{name}")
    count = 0
    if store.residuals is not None:
        store.residuals.repartition("t").write.mode("overwrite").partitionBy("t").parquet(f"{path}/residuals")
        count = store.residual_nnz()
    if store.node_bounds is not None:
        store.node_bounds.write.mode("overwrite").parquet(f"{path}/node_bounds")
    meta = {
        "schema_version": SCHEMA_VERSION, "n": store.n, "m": store.m, "num_steps": store.steps, "lambdas": list(store.lambdas), "residual_count": count, "has_residuals": count > 0,
        "has_bounds": store.node_bounds is not None, "bound_sigma_max": store.bound_sigma_max, "bound_constant": store.bound_constant, "entrywise_bound_scale": store.entrywise_bound_scale,
        "residual_format": store.residual_format, "diagnostics": store.diagnostics,
    }
    row = store.spark.range(1).select(F.lit(json.dumps(meta, default=str)).alias("meta"))
    row.coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_store(spark: SparkSession, path: str) -> FactorStore:
    """The saved store; newer versions, missing tables and wrong residual counts are refused."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    if meta["schema_version"] > SCHEMA_VERSION:
        raise ValueError(f"store version {meta['schema_version']} is newer than {SCHEMA_VERSION}")
    if missing := [k for k in ("n", "m", "num_steps", "lambdas") if k not in meta]:
        raise ValueError(f"the store lacks {', '.join(missing)}")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    residuals = None
    if meta["has_residuals"]:
        residuals = spark.read.parquet(f"{path}/residuals").select(F.col("t").cast("int").alias("t"), "u", "v", "value")
        if residuals.count() != meta["residual_count"]:
            raise ValueError("the number of residuals differs from the manifest")
    bounds = spark.read.parquet(f"{path}/node_bounds") if meta["has_bounds"] else None
    return FactorStore(
        **tables, lambdas=tuple(meta["lambdas"]), n=meta["n"], m=meta["m"], steps=meta["num_steps"], residuals=residuals, node_bounds=bounds, bound_sigma_max=meta["bound_sigma_max"],
        bound_constant=meta["bound_constant"], entrywise_bound_scale=meta["entrywise_bound_scale"], diagnostics=meta["diagnostics"], residual_format=meta["residual_format"],
    )


def load_config(path: str, overrides: list[str] | None = None) -> dict[str, Any]:
    """YAML with ``a.b=value`` overrides; a key that the file lacks, or a missing ``=``, is an error."""
    import yaml

    config = yaml.safe_load(Path(path).read_text()) or {}
    for item in overrides or []:
        key, eq, value = item.partition("=")
        if not eq:
            raise ValueError(f"override {item!r} has no =")
        *parents, last = key.split(".")
        at = config
        for p in parents:
            if not isinstance(at, dict) or p not in at:
                raise KeyError(key)
            at = at[p]
        if not isinstance(at, dict) or last not in at:
            raise KeyError(key)
        at[last] = yaml.safe_load(value)
    return config


def git_state() -> dict[str, Any]:
    """Commit and whether the working tree is changed; nulls outside a repository or without git."""

    def ask(*words: str) -> str | None:
        try:
            run = subprocess.run(["git", *words], capture_output=True, text=True, timeout=10)
        except (OSError, subprocess.SubprocessError):
            return None
        return run.stdout.strip() if run.returncode == 0 else None

    status = ask("status", "--porcelain")
    return {"commit": ask("rev-parse", "HEAD"), "branch": ask("rev-parse", "--abbrev-ref", "HEAD"), "changed": None if status is None else bool(status)}


def write_outputs(folder: str, metrics: dict[str, Any], config: dict[str, Any], title: str = "Experiment") -> None:
    """metrics.json, summary.md, resolved_config.yaml and run_metadata.json of a driver-side report."""
    import yaml

    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    resolved = yaml.safe_dump(config, sort_keys=True)
    (out / "metrics.json").write_text(json.dumps(metrics, indent=2, sort_keys=True, default=str))
    lines = [f"# {title}", "", "| metric | value |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in sorted(metrics.items())]]
    (out / "summary.md").write_text("\n".join(lines) + "\n")
    (out / "resolved_config.yaml").write_text(resolved)
    packages = {}
    for name in ("pyspark", "pyarrow", "pandas", "numpy", "PyYAML"):
        try:
            packages[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            packages[name] = None
    meta = {"config_sha256": hashlib.sha256(resolved.encode()).hexdigest(), "command": sys.argv, "platform": platform.platform(), "python": platform.python_version(), "packages": packages, "git": git_state()}
    (out / "run_metadata.json").write_text(json.dumps(meta, indent=2))


def append_records(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)


def pending(spark: SparkSession, grid: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Rows of the run grid that the records at ``path`` do not hold yet."""
    try:
        done = spark.read.option("header", True).csv(path).select(*keys)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        return grid
    return grid.join(done.select(*[F.col(k).cast(dict(grid.dtypes)[k]).alias(k) for k in keys]).distinct(), keys, "left_anti")
