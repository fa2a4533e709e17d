"""functions of the query-log diagnosis engine."""
