"""Plain rules over a stream of records: stateless, so detections leave with each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracewell.operators.detect import detections, resolver
from tracewell.plans.rules import Rule


def detect_stream(records: DataFrame, rules: list[Rule], aliases: dict[str, str] | None = None) -> DataFrame:
    """Detections of a streaming (or batch) DataFrame of records; count rules need all input and are left out."""
    return detections(records, rules, resolver(records, aliases))
