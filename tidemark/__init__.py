"""tidemark: market and event data analytics as plain ``DataFrame -> DataFrame`` operators on PySpark."""
