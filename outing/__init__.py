"""outing: event discovery, retrieval and corpus preparation as Spark plans."""
