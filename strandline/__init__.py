"""Analytics of labelled sequence windows on Spark."""
