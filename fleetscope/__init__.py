"""fleetscope: fleet telemetry analytics expressed as Spark DataFrame plans.

Layout
------
functions/   fixed lookup values and pure column expressions
sources/     readers for telemetry and road tables, quality gates, write-back
operators/   ordered per-vehicle scans, sessions, behaviour, scoring, features,
             fuel smoothing, nearest-road matching, model-table operators
plans/       composed jobs (driving style, session features, fuel, roads),
             reports, ML pipelines and the query registry
streaming/   Structured Streaming variant of session summaries
"""

__version__ = "0.1.0"
