"""weftline: incremental vector-sync analytics and corpus operators on PySpark."""
