"""Document analytics and retrieval evaluation on Spark."""
