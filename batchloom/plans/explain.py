"""What runs where, and why."""

from __future__ import annotations

from typing import TYPE_CHECKING

from batchloom.plans.eligibility import resource_profile
from batchloom.plans.settings import ADMISSION

if TYPE_CHECKING:
    from batchloom.operators.batch_frame import BatchFrame


def explain(frame: BatchFrame) -> str:
    """Settings, Spark's plan and a line for each decision."""
    from batchloom.operators.batch_frame import BatchFrame

    if not isinstance(frame, BatchFrame):
        raise TypeError("explain takes a BatchFrame")
    lines = [f"regions: {'enabled' if frame.settings.enabled else 'disabled'}, fusion: {'on' if frame.settings.fusion else 'off'}, admission: {frame.spark.conf.get(ADMISSION, 'on')}"]
    lines += ["plan:", frame.df._jdf.queryExecution().simpleString()]
    if not frame.settings.enabled:
        return "\n".join([*lines, "all stages run on plain Spark"])
    if frame.source is not None:
        lines.append(f"read: {frame.source}" + (", in the first region's tasks" if frame.reads_in_region else ""))
    for d in frame.decisions:
        names = " > ".join(s.label for s in frame.placed[d.first : d.last + 1])
        line = f"stage {d.first}" + (f" to {d.last}" if d.last > d.first else "") + f" [{names}]: {d.how}"
        if d.reason:
            line += f", reason={d.reason}"
        if d.note:
            line += f", not fused: {d.note}"
        _, without = resource_profile(frame.spark, d.spec.profile if d.spec else None)
        if without:
            line += f", no resource profile: {without}"
        lines.append(line)
    return "\n".join(lines)
