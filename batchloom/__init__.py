"""Batch maps over Spark DataFrames: exact batching, fused regions, stated fallbacks."""

from batchloom.operators.aggregates import Accumulator
from batchloom.operators.batch_frame import BatchFrame, Groups
from batchloom.plans.explain import explain
from batchloom.plans.settings import compatibility, disable, enable, is_enabled, settings, verify_compatibility
from batchloom.plans.specs import Profile, TaskPool, WorkerPool
from batchloom.sources.readers import from_items, from_range, read_parquet, read_row_groups

__all__ = [
    "Accumulator",
    "BatchFrame",
    "Groups",
    "Profile",
    "TaskPool",
    "WorkerPool",
    "compatibility",
    "disable",
    "enable",
    "explain",
    "from_items",
    "from_range",
    "is_enabled",
    "read_parquet",
    "read_row_groups",
    "settings",
    "verify_compatibility",
]
