"""stimulake: stimulus-response analytics as Spark DataFrame operators."""
