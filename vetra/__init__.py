"""vetra: Spark-native auditing and evaluation of large media inventories."""
