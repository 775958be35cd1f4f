"""quadweave: graph, full-text and vector analytics on PySpark."""
