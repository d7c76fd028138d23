"""Query plans: callables (spark, sf_dir) -> DataFrame with their oracle SQL."""
