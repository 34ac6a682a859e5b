"""Reading: partitioned tables, JSON lines, binary files, vector store bundles."""
