"""Query registry: Spark plans and their SQL counterparts."""
