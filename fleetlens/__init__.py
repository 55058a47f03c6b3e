"""fleetlens: fleet telemetry ETL, hourly rollups, usage analytics and alerting on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function built from native Spark
expressions, so the same code serves batch jobs and Structured Streaming micro-batches.
"""

__version__ = "0.1.0"
