"""loam: knowledge-graph retrieval analytics as Spark DataFrame plans."""
