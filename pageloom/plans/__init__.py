"""Relations derived from tables, and the registered queries."""
