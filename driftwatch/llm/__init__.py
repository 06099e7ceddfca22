"""Operators of a training-data pipeline (dedup, filters, decontamination,
sharding, binary output, packing) and the queries that apply them.

Nothing outside this package imports it; ``__spark_entry__.py`` adds
``queries.QUERIES`` and ``queries.ORACLES`` when it is present.
"""
