"""Star-schema mart, declarative query and lineage analytics on PySpark."""
