"""marketlens: retail customer analytics on Spark DataFrames.

Layers: ``sources`` (table binding and sinks), ``functions`` (shared column
expressions, exact rounding, global ordering), ``operators`` (warehouse,
checks, quality, repairs, mart, segmentation, customer analytics, reports),
``plans`` (end-to-end pipelines and the query registry), ``streaming``
(intentionally empty: the analysed project has no stream processing).
"""

__version__ = "0.1.0"
