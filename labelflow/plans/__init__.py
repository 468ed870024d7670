"""Query plans over the driver's test tables: the ``queries()`` catalogue,
its DuckDB oracles, and the end-to-end experiment runs."""
