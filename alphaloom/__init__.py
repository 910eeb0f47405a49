"""Cross-sectional factor research on Spark: a formula language, its compiler to window columns, backtests and search."""
