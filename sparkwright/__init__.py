"""DataFrame operators for inspection data, retrieval, geometry and ledgers on Apache Spark."""
