"""The registered queries of this subpackage: one thin query per operator over
its whole table, with the SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import (
    bag_minhash,
    decontaminate,
    gated_lm,
    hd_language,
    host_rules,
    html_extract,
    license_scan,
    packing,
    periodic_runs,
    rule_ensemble,
    shard_tree,
    token_counts,
    turn_repair,
)
from ledgerlens.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("text_key")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_rules(read_table(spark, sf_dir, "documents"))


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_lm.score(read_table(spark, sf_dir, "documents"))


def op6_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_duplicates(read_table(spark, sf_dir, "documents")).drop("text_key")


def op7_hd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hd_language.identify(read_table(spark, sf_dir, "documents"))


def op8_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.shard(read_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.structure(read_table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = periodic_runs.with_planted_runs(read_table(spark, sf_dir, "documents"))
    return periodic_runs.digest(periodic_runs.periodic_runs(planted))


def op13_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    found = [
        op1_decontaminate,
        op2_license_scan,
        op3_host_rules,
        op4_rule_ensemble,
        op5_gated_lm,
        op6_bag_minhash,
        op7_hd_language,
        op8_shard_tree,
        op9_packing,
        op10_token_counts,
        op11_turn_repair,
        op12_periodic_runs,
        op13_html_extract,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from ledgerlens.llm.oracle import ORACLE

    return dict(ORACLE)
