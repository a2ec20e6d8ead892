"""DuckDB SQL for the queries that SQL can express."""

from . import centroids, licenses, quality

SQL: dict[str, str] = {"op1_license_scans": licenses.sql(), "op2_quality_rules": quality.sql(), "op13_centroid_clustering": centroids.sql()}
