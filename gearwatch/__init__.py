"""Equipment-health analytics as Spark DataFrame operators."""
