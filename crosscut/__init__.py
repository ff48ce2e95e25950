"""Panel analytics on Spark: returns, volatility, cross-sections, regimes, correlation, alerts and gates."""
