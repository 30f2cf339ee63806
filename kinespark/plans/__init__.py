"""Stand-in views, queries and compositions of operators."""
