"""tapeloom: market analytics as Spark DataFrame operators."""
