"""A Spark-first analytics engine: SQL front end, versioned tables, catalogs and data-pipeline operators."""

__version__ = "0.1.0"
