"""The queries of the core problem operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwright.operators.packed_fields import cells_of, packed_values
from loomwright.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    cells = cells_of(table(spark, d, "experts_full"), "experts_full", "row_idx", ["research_field", "application", "duty"])
    cells = cells.unionByName(cells_of(table(spark, d, "achievements_full"), "achievements_full", "row_idx", ["application", "scene_lable"]))
    return packed_values(cells).selectExpr("source as source_table", "row as row_idx", "field as field_name", "pos", "item")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found}
