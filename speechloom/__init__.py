"""Speech-corpus preparation and evaluation on Spark."""
