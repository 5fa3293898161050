"""From checked queries to Spark plans: joins, windows and aggregations where they can say it, the matcher elsewhere."""
