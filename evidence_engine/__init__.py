"""evidence_engine: evidence retrieval and knowledge-graph analytics as Spark DataFrame plans."""
