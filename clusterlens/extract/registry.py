"""Extractor plug-in point: functions from the nodes DataFrame to one telemetry table."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

Extractor = Callable[[DataFrame], DataFrame]

#: Table name to extractor, in registration order.
EXTRACTORS: dict[str, Extractor] = {}

log = logging.getLogger(__name__)


def extractor(table: str):
    """Register ``f(nodes) -> DataFrame`` as the source of a table."""

    def register(fn: Extractor) -> Extractor:
        EXTRACTORS[table] = fn
        return fn

    return register


def run_extractors(
    nodes: DataFrame, registry: Mapping[str, Extractor] | None = None
) -> dict[str, DataFrame]:
    """Every extractor over every node: lazy selects on one DataFrame, no join.

    An extractor that cannot be planned is logged and left out; the others go on.
    """
    tables: dict[str, DataFrame] = {}
    for table, fn in (registry or EXTRACTORS).items():
        try:
            tables[table] = fn(nodes)
        except Exception as e:  # one plug-in must not stop the others
            log.warning("extractor of %s failed: %s", table, e)
    return tables
