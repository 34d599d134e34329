"""Spark-first analytics over source code, review findings, SARIF reports and execution traces."""
