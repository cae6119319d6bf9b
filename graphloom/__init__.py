"""graphloom: code-graph, memory-retrieval and change-detection analytics on PySpark."""

__version__ = "0.1.0"
