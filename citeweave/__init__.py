"""citeweave: bibliometric analytics on Spark DataFrames.

Layout: ``sources`` (readers, the landed collection, page extraction,
sinks), ``functions`` (native column expressions), ``operators``
(dedupe, statistics, warehouse, OLAP views, graph, text, LDA), ``plans``
(named queries and their SQL oracles) and ``streaming`` (incremental ingest).
"""
