"""Payment-card analytics as PySpark DataFrame operators."""
