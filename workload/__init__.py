"""The registered queries: Spark jobs over the given tables, each with its SQL counterpart."""
