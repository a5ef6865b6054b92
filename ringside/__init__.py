"""Match-event analytics as PySpark DataFrame operators."""
