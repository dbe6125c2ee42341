"""Code-graph, retrieval and corpus analytics as ordinary Spark DataFrame programs."""
