"""API-lifecycle analytics on Spark: registry, discovery, usage, tiers, rewrites."""
