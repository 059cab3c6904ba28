"""quillspan: a Spark-native engine for retrieval, graph and corpus analytics."""
