"""End-to-end jobs, the registered queries and their SQL counterparts."""
