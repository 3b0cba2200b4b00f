"""faultline: code-change risk analytics as Spark DataFrame operators."""
