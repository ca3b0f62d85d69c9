"""chronoloom: temporal-network analytics as PySpark DataFrame operators."""
