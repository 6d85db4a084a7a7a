"""ctxloom: a Spark-native context-graph and corpus-processing engine."""
