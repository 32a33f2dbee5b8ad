"""DataFrame operators: joins with spines, scoring, statistics, sampling, similarity, graphs, documents and state."""
