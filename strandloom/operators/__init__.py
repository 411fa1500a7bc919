"""DataFrame operators over reads, k-mers, edges and digraphs."""
