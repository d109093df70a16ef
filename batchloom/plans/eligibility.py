"""Which stages may run in regions; what declines a stage is kept as its reason."""

from __future__ import annotations

import inspect
import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from batchloom.operators.worker import MapConfig
from batchloom.plans.specs import Declined, Profile, RegionSpec, Transform, WorkerPool, profile_of

NATIVE_FORMATS = ("pyarrow", "pandas")
FORMATS = (*NATIVE_FORMATS, "numpy")


@dataclass(frozen=True)
class MapStage:
    """A map that a user asked for."""

    config: MapConfig
    compute: Any = field(default_factory=WorkerPool)
    options: Mapping[str, Any] = field(default_factory=dict)
    options_fn: Any = None
    limit: int | None = None
    label: str = "map"


@dataclass(frozen=True)
class Eligibility:
    """A region of one stage, or the reason against it."""

    spec: RegionSpec | None
    reason: str | None = None


def is_synchronous(fn: Any) -> bool:
    """Whether calling ``fn`` gives its result at once: no coroutine or asynchronous generator anywhere."""
    targets = [fn, getattr(fn, "func", None)]
    if not inspect.isfunction(fn):
        targets.append(getattr(fn, "__call__", None))  # noqa: B004  the method itself is looked at
    return callable(fn) and not any(inspect.iscoroutinefunction(t) or inspect.isasyncgenfunction(t) for t in targets if t is not None)


def map_eligibility(stage: Any, slots: int) -> Eligibility:
    """The checks in order; the first that fails is the reason."""
    if type(stage) is not MapStage:
        return Eligibility(None, "not a plain batch map")
    config = stage.config
    size = config.batch_size
    checks = (
        (is_synchronous(config.fn), "the batch function is not synchronous"),
        (config.batch_format in NATIVE_FORMATS, f"batch format {config.batch_format!r} is not native"),
        (isinstance(size, int) and not isinstance(size, bool) and size > 0, "batch_size is not a positive integer"),
        (stage.limit is None, "limits per partition are not supported"),
        (stage.options_fn is None, "options computed at run time are not supported"),
    )
    for good, reason in checks:
        if not good:
            return Eligibility(None, reason)
    try:
        profile = profile_of(stage.compute, stage.options, slots, "map")
    except Declined as e:
        return Eligibility(None, str(e))
    return Eligibility(RegionSpec((Transform("map_batches", config),), profile))


def resource_profile(spark: SparkSession, profile: Profile | None) -> tuple[Any, str | None]:
    """Spark's resource profile for a region, or why there is none."""
    if profile is None or (profile.gpus, profile.cpus, profile.memory, profile.resources) == (0, 1.0, None, None):
        return None, None
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return None, "resource profiles need a cluster; the session is local"
    return build_profile(profile), None


def build_profile(profile: Profile) -> Any:
    """All fields of a profile as Spark's: tasks ask for CPUs and resources, executors for memory and what their tasks ask."""
    from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

    tasks, executors = TaskResourceRequests().cpus(max(1, math.ceil(profile.cpus))), ExecutorResourceRequests()
    for name, amount in (("gpu", profile.gpus), *(profile.resources or ())):
        if amount:
            tasks = tasks.resource(name, float(amount))
            executors = executors.resource(name, max(1, math.ceil(amount)))
    builder = ResourceProfileBuilder().require(tasks)
    if profile.memory:
        executors = executors.memory(f"{math.ceil(profile.memory)}m")
    return builder.require(executors).build if executors.requests else builder.build
