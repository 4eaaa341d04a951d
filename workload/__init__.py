"""The registered queries: inputs derived from the given tables, Spark queries, and SQL to check them."""
