"""The operators applied to the test tables, each query with its SQL counterpart."""
