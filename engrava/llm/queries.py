"""The queries of this subpackage: each takes (spark, sf_dir) and runs over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engrava.llm import clusters, incremental, leaks, neardup, packing, pairs, pii, residue, vectors
from engrava.session import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.found(load(spark, sf_dir, "memories"))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.described(load(spark, sf_dir, "memories"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.occurrences(pii.tables_of(load(spark, sf_dir, "memories"), load(spark, sf_dir, "turns")))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(pii.tables_of(load(spark, sf_dir, "memories"), load(spark, sf_dir, "turns")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.links(neardup.tables_of(load(spark, sf_dir, "memories"), load(spark, sf_dir, "write_guard_drops")))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(neardup.tables_of(load(spark, sf_dir, "memories"), load(spark, sf_dir, "write_guard_drops")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.found(load(spark, sf_dir, "entity_mentions"))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.all_scores(load(spark, sf_dir, "entity_mentions")).drop("npmi")


def p4_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.updated(load(spark, sf_dir, "entity_mentions")).drop("npmi")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.found(load(spark, sf_dir, "memories"))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.neighbour_table(load(spark, sf_dir, "memories"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.found(load(spark, sf_dir, "memories"), load(spark, sf_dir, "incoming_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.found(load(spark, sf_dir, "documents"), load(spark, sf_dir, "pack_budgets"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(load(spark, sf_dir, "documents"), load(spark, sf_dir, "pack_budgets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.found(load(spark, sf_dir, "documents"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.scores(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_clusters, p2_found, p2_redacted, p3_found, p3_groups, p4_found, p4_pairs, p4_updated, p5_found, p5_neighbours, p6_found, p7_found, p7_containers, p8_found, p9_found, p9_scores)}
