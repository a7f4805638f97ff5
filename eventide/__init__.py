"""Event-volatility analytics on Spark: DataFrame in, DataFrame out."""
