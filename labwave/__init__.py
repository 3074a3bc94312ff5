"""labwave: clinical lab-series analytics as plain Spark DataFrame operators.

Packages: ``functions`` (column expressions), ``sources`` (scans, SQL, sinks,
catalog), ``operators`` (cleaning, reshaping, attribution, runs, diagnostics,
roll-ups, codebooks), ``plans`` (driver-table adapters, registered queries,
SQL oracles).
"""
