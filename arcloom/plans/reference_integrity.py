"""Problem 6: orphan references of the project's tables, as rows and as a monthly report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arcloom.operators.orphans import orphan_report, project_orphans
from arcloom.tables import table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_orphans(*(table(spark, sf_dir, n) for n in ("code_map", "features", "modules", "graph_edge", "vertices")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("table_name", "field_name", "row_id", "reason")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


QUERIES = {"p6_found": p6_found, "p6_report": p6_report}

_ORPHANS = """
WITH refs AS (
  SELECT 'code_map' AS table_name, 'feature' AS field_name, id AS row_id, NULL::INTEGER AS repo, feature::VARCHAR AS k, created_at, loaded_at FROM code_map
  UNION ALL SELECT 'features', 'module', id, NULL, module::VARCHAR, created_at, loaded_at FROM features
  UNION ALL SELECT 'graph_edge', 'src', id, repo, src, created_at, loaded_at FROM graph_edge
  UNION ALL SELECT 'graph_edge', 'dest', id, repo, dest, created_at, loaded_at FROM graph_edge
), ref AS (
  SELECT table_name, field_name, row_id, any_value(repo) AS repo, any_value(k) AS k, any_value(created_at) AS created_at, min(loaded_at) AS r_at
  FROM refs WHERE k IS NOT NULL GROUP BY ALL
), tgts AS (
  SELECT 'code_map' AS table_name, NULL::INTEGER AS repo, id::VARCHAR AS k, loaded_at, deleted_at FROM features
  UNION ALL SELECT 'features', NULL, id::VARCHAR, loaded_at, deleted_at FROM modules
  UNION ALL SELECT 'graph_edge', repo, id, loaded_at, deleted_at FROM vertices
), tgt AS (
  SELECT table_name, repo, k, min(loaded_at) AS t_at, min(deleted_at) AS t_deleted FROM tgts GROUP BY table_name, repo, k
), j AS (
  SELECT ref.*, tgt.k IS NOT NULL AS hit, t_at, t_deleted
  FROM ref LEFT JOIN tgt ON ref.table_name = tgt.table_name AND ref.k = tgt.k AND ref.repo IS NOT DISTINCT FROM tgt.repo
), orphans AS (
  SELECT table_name, field_name, row_id, 'missing' AS reason, created_at FROM j WHERE NOT hit
  UNION ALL SELECT table_name, field_name, row_id, 'late', created_at FROM j WHERE hit AND t_at > r_at
  UNION ALL SELECT table_name, field_name, row_id, 'deleted', created_at FROM j WHERE hit AND t_deleted <= r_at
)
"""

ORACLE = {
    "p6_found": _ORPHANS + "SELECT table_name, field_name, row_id, reason FROM orphans",
    "p6_report": _ORPHANS + "SELECT table_name, field_name, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS month, reason, count(*) AS n FROM orphans GROUP BY ALL",
}
