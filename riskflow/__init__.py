"""riskflow: transaction-risk analytics expressed as Spark DataFrame plans.

Subpackages
-----------
sources    readers, derived views over the test tables, sinks
functions  row-local column expressions (parser, scoring, JSON, formats)
operators  DataFrame -> DataFrame operators (validation, ordered features,
           feedback fold, velocity, drift, metrics, audit, explain, ML)
plans      end-to-end compositions and the registered query catalog
streaming  Structured Streaming jobs (velocity, dead letters, scoring)
"""

__version__ = "0.1.0"
