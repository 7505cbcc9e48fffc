"""No streaming operators.

The analysed project is a batch warehouse: it has no streams, watermarks,
event-time windows or stateful operators, so nothing is built here.
"""
