"""barweave: portfolio analytics over long tables of price bars, on Spark."""
