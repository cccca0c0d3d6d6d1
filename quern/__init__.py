"""quern: nested-columnar reading, record assembly and file introspection on Spark."""
