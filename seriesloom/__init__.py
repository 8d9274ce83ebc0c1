"""Demand-series analytics on Spark: raw readings in, cleaned series, forecasts,
scores, edits and run history out. Every operator takes and returns DataFrames."""
