"""The query catalogue over the driver's tables: Spark plans and their SQL counterparts."""
