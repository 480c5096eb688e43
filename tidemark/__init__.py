"""tidemark: a bar-research engine on Spark DataFrames.

Sub-packages: ``sources`` (scans, sinks, table proxies), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame), ``plans`` (registered
queries with their SQL counterparts) and ``streaming`` (incremental refresh).
"""
