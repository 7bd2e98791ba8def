"""Evidence, entity and event analytics as Spark DataFrame operators."""
