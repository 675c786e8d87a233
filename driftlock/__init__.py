"""driftlock: lock what a DataFrame transform does today, prove what a migration changed."""
