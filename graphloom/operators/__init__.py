"""Graph, search, health and maintenance operators over node and edge tables."""
