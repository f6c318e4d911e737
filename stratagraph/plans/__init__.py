"""Query catalogue: named Spark plans over the driver tables and their SQL counterparts."""
