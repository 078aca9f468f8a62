"""Commands from a JSON configuration: ``python -m gridloom.plans.cli config.json``.

A configuration is a list of steps, each {"command": name, ...options}; steps run in order in
one session. A batch is a configuration with "sweep": {option: [values]}, run for every combination.
"""

from __future__ import annotations

import itertools
import json
import sys
import threading
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from ..operators import bias, collect, qa, solar
from ..sources import scan, sinks
from .downscale import configured
from .handler import handler_by_name


#: Key columns that a result keeps beside chosen features.
KEYS = ("gid", "south_north", "west_east", "latitude", "longitude", "t_idx", "time")


def extract(spark: SparkSession, source, out: str, features: list[str], handler: str = "base", **options) -> None:
    handler_by_name(handler, features=features, **options).from_files(spark, source).write.parquet(out)


def bias_calc(spark: SparkSession, base: str, bias_source: str, feature: str, out: str, method: str = "linear", future: str | None = None) -> None:
    observed, modelled = spark.read.parquet(base), spark.read.parquet(bias_source)
    done = {
        "linear": lambda: bias.linear_factors(observed, modelled, feature),
        "scalar": lambda: bias.linear_factors(observed, modelled, feature, True),
        "monthly": lambda: bias.monthly_factors(observed, modelled, feature),
        "qdm": lambda: bias.qdm_params(observed, modelled, spark.read.parquet(future), feature),
        "presrat": lambda: bias.presrat_params(observed, modelled, spark.read.parquet(future), feature),
        "skill": lambda: bias.skill_assessment(observed, modelled, feature),
    }[method]()
    done.write.parquet(out)


def bias_apply(spark: SparkSession, source: str, factors: str, features: list[str], out: str, method: str = "linear") -> None:
    bias.correct(spark.read.parquet(source), method, spark.read.parquet(factors), features).write.parquet(out)


def side_by_side(spark: SparkSession, jobs: dict[str, Callable[[], None]], at_once: int = 8) -> None:
    """Run jobs at the same time in threads of one session, each in a scheduler pool of its own name; the first failure is raised when all are done."""
    failed: dict[str, BaseException] = {}
    slots = threading.Semaphore(at_once)

    def run_one(name: str, job: Callable[[], None]) -> None:
        with slots:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
            try:
                job()
            except BaseException as e:  # noqa: BLE001  told below
                failed[name] = e

    threads = [InheritableThread(run_one, args=(name, job), session=spark) for name, job in jobs.items()]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if failed:
        name = sorted(failed)[0]
        raise RuntimeError(f"{len(failed)} of {len(jobs)} jobs failed, {name} first") from failed[name]


def data_collect(spark: SparkSession, sources: list[str], out: str, features: list[str] | None = None, dset_split: bool = False, integers: bool = False, overlap: bool = True) -> None:
    """Chunk files as one data set; with ``dset_split`` one a feature, under ``out`` with {feature} in it, by jobs side by side."""
    frames = [spark.read.parquet(s) for s in scan.expand(sources)]
    keys = [c for c in frames[0].columns if c in KEYS]
    chosen = features or [c for c in frames[0].columns if c not in KEYS]

    def write(some: list[str], path: str) -> None:
        whole = collect.combine([f.select(*keys, *[c for c in some if c in f.columns]) for f in frames], overlap=overlap)
        sinks.write_output(whole, path, some, limits=False, integers=integers)

    if not dset_split:
        write(chosen, out)
    elif "{feature}" not in out:
        raise ValueError("with dset_split out needs {feature}")
    else:
        side_by_side(spark, {f: (lambda f=f: write([f], out.format(feature=f))) for f in chosen})


def solar_run(spark: SparkSession, source: str, out: str, features: list[str] | None = None, overwrite: bool = False) -> None:
    """Irradiance of hourly data, all columns or the keys and ``features``; a result that is there stays unless ``overwrite``."""
    if scan.cached(spark, out, ["all"])[0] and not overwrite:
        return
    df = spark.read.parquet(source)
    solar.require_hourly(df)
    done = solar.irradiance(df)
    if features:
        done = done.select(*[c for c in KEYS if c in done.columns], *features)
    done.write.mode("overwrite").parquet(out)


def forward_pass(spark: SparkSession, source: str, out: str, models: list[dict], chunk: list[int], pad: list[int] = (0, 0, 0), exogenous: dict[str, dict] | None = None, limits: bool = True, overwrite: bool = False) -> None:
    """A chain of models over a cube, chunks that ``out`` has already left out unless ``overwrite``; each exogenous feature names its ``source`` of points."""
    fields = {f: spark.read.parquet(o["source"]) for f, o in (exogenous or {}).items()}
    down, cube = configured(spark.read.parquet(source), models, chunk, pad, exogenous, fields, limits=limits)
    written = None if overwrite or not scan.cached(spark, out, ["all"])[0] else spark.read.parquet(out)
    down.run(cube, written).write.mode("overwrite" if overwrite else "append").parquet(out)


def qa_run(spark: SparkSession, fine: str, source: str, features: list[str], s: int, t: int, out: str, bias_method: str | None = None, factors: str | None = None) -> None:
    """Coarsened again, true and difference of each feature as single-precision columns; the source is corrected first with ``bias_method``."""
    true = spark.read.parquet(source)
    if bias_method:
        true = bias.correct(true, bias_method, spark.read.parquet(factors), features)
    done = qa.recoarsen_error(spark.read.parquet(fine), true, features, s, t)
    done.withColumns({f"{f}_{kind}": done[f"{f}_{kind}"].cast("float") for f in features for kind in ("synthetic", "true", "error")}).write.parquet(out)


COMMANDS: dict[str, Callable] = {"extract": extract, "bias-calc": bias_calc, "bias-apply": bias_apply, "data-collect": data_collect, "solar": solar_run, "qa": qa_run, "forward-pass": forward_pass}


def expand_sweep(step: dict) -> list[dict]:
    """One step for every combination of swept values; {option} in texts takes the value."""
    sweep = step.get("sweep") or {}
    rest = {k: v for k, v in step.items() if k != "sweep"}
    out = []
    for values in itertools.product(*sweep.values()):
        chosen = dict(zip(sweep, values, strict=True))
        filled = {k: v.format(**chosen) if isinstance(v, str) and sweep else v for k, v in rest.items()}
        out.append({**filled, **chosen})
    return out


def run(spark: SparkSession, steps: list[dict]) -> None:
    plan = [s for step in steps for s in expand_sweep(step)]
    unknown = {s.get("command") for s in plan} - set(COMMANDS)
    if unknown:
        raise ValueError(f"unknown commands {sorted(map(str, unknown))}; known: {sorted(COMMANDS)}")
    for s in plan:
        COMMANDS[s["command"]](spark, **{k: v for k, v in s.items() if k != "command"})


if __name__ == "__main__":
    with open(sys.argv[1]) as f:
        run(SparkSession.builder.appName("gridloom").getOrCreate(), json.load(f))
