"""Evidence retrieval and answer evaluation over document collections, on PySpark."""
