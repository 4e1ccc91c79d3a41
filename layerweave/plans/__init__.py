"""End-to-end jobs and the registered queries with their SQL twins."""
