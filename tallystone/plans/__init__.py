"""Named queries and their oracle SQL, gathered for the driver contract."""
