"""Queries of the training-data operators, and SQL for those that SQL can check on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import clusters, components, history, near_duplicates, neighbours, packing, seen, subjects, subset, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": near_duplicates.p1_found,
        "p1_groups": near_duplicates.p1_groups,
        "p2_subset": subset.p2_subset,
        "p2_sizes": subset.p2_sizes,
        "p3_found": history.p3_found,
        "p4_found": components.p4_found,
        "p5_found": seen.p5_found,
        "p5_error_rate": seen.p5_error_rate,
        "p5_error_rate_24": seen.p5_error_rate_24,
        "p6_found": neighbours.p6_found,
        "p7_found": clusters.p7_found,
        "p7_clusters": clusters.p7_clusters,
        "p8_ids": tokens.p8_ids,
        "p8_roundtrip": tokens.p8_roundtrip,
        "p9_packed": packing.p9_packed,
        "p9_fill": packing.p9_fill,
        "p9_violations": packing.p9_violations,
        "p10_found": subjects.p10_found,
        "p10_shares": subjects.p10_shares,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": near_duplicates.P1_FOUND_SQL,
        "p1_groups": near_duplicates.P1_GROUPS_SQL,
        "p2_sizes": subset.P2_SIZES_SQL,
        "p3_found": history.P3_FOUND_SQL,
        "p4_found": components.P4_FOUND_SQL,
        "p5_found": seen.P5_FOUND_SQL,
        "p5_error_rate": seen.P5_ERROR_RATE_SQL,
        "p5_error_rate_24": seen.P5_ERROR_RATE_24_SQL,
        "p6_found": neighbours.P6_FOUND_SQL,
        "p7_found": clusters.P7_FOUND_SQL,
        "p7_clusters": clusters.P7_CLUSTERS_SQL,
        "p8_roundtrip": tokens.P8_ROUNDTRIP_SQL,
        "p9_violations": packing.P9_VIOLATIONS_SQL,
    }
