"""Entity-type matching between ontologies, planned as Spark DataFrame operations."""
