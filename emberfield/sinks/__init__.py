"""Writers. A finished Spark write job is the atomic step."""
