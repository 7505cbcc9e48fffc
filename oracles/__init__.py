"""Independent DuckDB SQL oracles for the registered queries.

Written by hand in SQL (never generated from the Spark code); the shared
prefix binds the driver tables to the source roles and builds the star
schema with window functions, which is fine for a single-node oracle.
"""
