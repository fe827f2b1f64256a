"""Logical tables over Parquet inputs."""
