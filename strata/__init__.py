"""strata: layered (Bronze, Silver, Gold) data pipelines on Spark DataFrames.

Sub-packages: ``sources`` (scans), ``functions`` (column functions),
``operators`` (quality, dedup, joins, aggregates, windows, audits),
``sinks`` (writes and layout), ``plans`` (stage compositions and the
driver query catalogue), ``streaming`` (file-stream Bronze and Silver).
"""

__version__ = "0.1.0"
