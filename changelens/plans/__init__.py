"""Relations derived from the shared tables, and the registered queries with their SQL."""
