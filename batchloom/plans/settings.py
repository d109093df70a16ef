"""Whether regions are used, per session or per frame; off until ``enable``."""

from __future__ import annotations

from dataclasses import dataclass

import pyspark
from pyspark.sql import DataFrame, SparkSession

ENABLED, FUSION, ADMISSION = "batchloom.enabled", "batchloom.fusion", "batchloom.admission"


@dataclass(frozen=True)
class Compatibility:
    """What this Spark offers; ``missing`` names what regions would need."""

    version: str
    missing: tuple[str, ...]

    @property
    def compatible(self) -> bool:
        return not self.missing


@dataclass(frozen=True)
class Settings:
    """Taken when a frame is made, so that later changes don't touch frames that exist."""

    enabled: bool = False
    fusion: bool = True


def compatibility(spark: SparkSession) -> Compatibility:
    """A report that never raises."""
    needs = {"map_in_arrow": hasattr(DataFrame, "mapInArrow"), "python_data_source": hasattr(spark, "dataSource"), "version_4": int(pyspark.__version__.split(".")[0]) >= 4}
    return Compatibility(pyspark.__version__, tuple(name for name, good in needs.items() if not good))


def verify_compatibility(spark: SparkSession) -> None:
    if missing := compatibility(spark).missing:
        raise RuntimeError(f"this Spark lacks {', '.join(missing)}")


def enable(spark: SparkSession, fusion: bool = True) -> SparkSession:
    """Use regions in frames made from now on; checks compatibility before it changes anything."""
    if not isinstance(fusion, bool):
        raise TypeError("fusion is True or False")
    verify_compatibility(spark)
    spark.conf.set(ENABLED, "true")
    spark.conf.set(FUSION, str(fusion).lower())
    return spark


def disable(spark: SparkSession) -> SparkSession:
    """Back to plain Spark; removes only what ``enable`` set."""
    for key in (ENABLED, FUSION):
        spark.conf.unset(key)
    return spark


def settings(spark: SparkSession) -> Settings:
    return Settings(spark.conf.get(ENABLED, "false") == "true", spark.conf.get(FUSION, "true") == "true")


def is_enabled(spark: SparkSession) -> bool:
    return settings(spark).enabled
