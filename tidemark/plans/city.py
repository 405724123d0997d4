"""A city's run from terrain to scores as stages, each stored under a key of what it follows from.

A stage's key is a digest of its name and version, the options that it reads and
the keys of its inputs.  What stands under that key in the shared store is read
back; only what follows from a changed source or option is computed again.  A
stage that was lost half-way has no success mark and is computed anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.depth import burned, crested
from tidemark.operators import graph, scoring, terrain
from tidemark.operators.grid import keys
from tidemark.operators.zonal import severity_areas
from tidemark.plans import forcing, hazard
from tidemark.sources.storage import stands

Tables = dict[str, DataFrame]
Options = dict[str, object]


class Stage(NamedTuple):
    """``build`` makes the stage's table from its ``inputs`` (sources or stages) and the ``options`` it names."""

    name: str
    build: Callable[[Tables, Options], DataFrame]
    inputs: tuple[str, ...]
    options: tuple[str, ...] = ()
    version: int = 1


class Source(NamedTuple):
    """A given table and a text that changes with its content, such as a path with a date."""

    table: DataFrame
    version: str


def key_of(stage: Stage, options: Options, input_keys: dict[str, str]) -> str:
    """What a stage's table follows from, as a digest."""
    told = {"name": stage.name, "version": stage.version, "options": {o: options.get(o) for o in stage.options}, "inputs": {i: input_keys[i] for i in stage.inputs}}
    return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()[:24]


def run(spark: SparkSession, store: str, sources: dict[str, Source], options: Options, stages: tuple[Stage, ...] | None = None) -> tuple[Tables, list[str]]:
    """The stages' tables by name, and the names of those that had to be computed.

    ``stages`` stand in an order in which each comes after its inputs, those of
    a city by default.
    """
    tables: Tables = {name: s.table for name, s in sources.items()}
    found = {name: hashlib.sha256(s.version.encode()).hexdigest()[:24] for name, s in sources.items()}
    computed = []
    for stage in CITY if stages is None else stages:
        missing = [i for i in stage.inputs if i not in tables]
        if missing:
            raise ValueError(f"{stage.name} needs {', '.join(missing)}")
        found[stage.name] = key_of(stage, options, found)
        path = f"{store.rstrip('/')}/{stage.name}-{found[stage.name]}"
        if not stands(spark, path):
            computed.append(stage.name)
            stage.build({i: tables[i] for i in stage.inputs}, {o: options.get(o) for o in stage.options}).write.mode("overwrite").parquet(path)
        tables[stage.name] = spark.read.parquet(path)
    return tables, computed


# the stages of a city; ``terrain`` has row, col, z and optionally channel, crest and sink_cm_a, how fast the ground sinks


def _ground(t: Tables, o: Options) -> DataFrame:
    """Ground of the present day, with crests burned in."""
    cells = t["terrain"]
    z = F.col("z")
    if "sink_cm_a" in cells.columns:
        z = z - F.round(F.coalesce("sink_cm_a", F.lit(0.0)) / 100 * float(o.get("years") or 0), 3)
    if "crest" in cells.columns:
        z = crested(z, F.col("crest"))
    channel = F.coalesce(F.col("channel"), F.lit(False)) if "channel" in cells.columns else F.lit(False)
    return cells.select(*keys(cells), z.alias("z"), channel.alias("channel"))


def _routing(t: Tables, o: Options) -> DataFrame:
    """Keys, z, the filled surface, conditioned directions and the height over the drainage."""
    ground = t["ground"]
    k = keys(ground)
    low = ground.withColumn("z", burned("z", F.col("channel"), float(o.get("burn") or 0.0)))
    surface = terrain.filled_surface(low)
    given = ground.select(*k, F.col("channel").alias("drain"))
    product = terrain.hand_product(low, given, int(o.get("drain_cells") or 500))
    return ground.select(*k, "z", "channel").join(surface.select(*k, "filled"), k, "left").join(product.select(*k, "hand"), k, "left")


def _sea(t: Tables, o: Options) -> DataFrame:
    cells = t["ground"]
    last = cells.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    border = F.col("row").isin(0, last.r) | F.col("col").isin(0, last.c)
    return graph.sea_mask(cells, border)


def _levels(t: Tables, o: Options) -> DataFrame:
    """Levels of every scenario and horizon from the baseline and the scenarios' warming and sea-level rise."""
    base = t["baseline"].select("hazard_type", "return_period", F.col("water_level_m").alias("baseline_water_level_m"), F.lit(1.0).alias("gev_scale_mm"))
    return forcing.scenario_levels(base, t["scenarios"], float(o.get("rate") or 0.07)).select("hazard_type", "return_period", "scenario", "horizon", "water_level_m")


def _depths(t: Tables, o: Options) -> DataFrame:
    """Depths of one scenario and horizon under all hazards and return periods; sea cells are dry."""
    own = t["levels"].where((F.col("scenario") == F.lit(o["scenario"])) & (F.col("horizon") == F.lit(o["horizon"])))
    cells = t["routing"]
    last = cells.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    border = F.col("row").isin(0, last.r) | F.col("col").isin(0, last.c)
    at = cells.join(t["sea"], keys(cells))
    return hazard.multihazard_depths(at, own, border, sea="sea", river="channel")


def _summary(t: Tables, o: Options) -> DataFrame:
    return hazard.summary(t["depths"])


def _areas(t: Tables, o: Options) -> DataFrame:
    return severity_areas(t["depths"], "hazard_type", "return_period")


def _scores(t: Tables, o: Options) -> DataFrame:
    """Skill of the deepest hazard at one return period against the point register, with the gate's verdict."""
    at = t["depths"].where(F.col("return_period") == F.lit(o["scored_period"]))
    deepest = at.groupBy("row", "col").agg(F.max("depth").alias("depth"))
    return scoring.validated(scoring.point_scores(t["register"], deepest, threshold=float(o.get("threshold") or 0.10)))


CITY = (
    Stage("ground", _ground, ("terrain",), ("years",)),
    Stage("routing", _routing, ("ground",), ("burn", "drain_cells")),
    Stage("sea", _sea, ("ground",)),
    Stage("levels", _levels, ("baseline", "scenarios"), ("rate",)),
    Stage("depths", _depths, ("routing", "sea", "levels"), ("scenario", "horizon")),
    Stage("summary", _summary, ("depths",)),
    Stage("areas", _areas, ("depths",)),
    Stage("scores", _scores, ("depths", "register"), ("scored_period", "threshold")),
)
