"""The registered queries: each operator over the given tables, with oracle SQL."""
