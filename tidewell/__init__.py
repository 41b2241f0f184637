"""Spark-native surveillance analytics: relational layer, panels, diagnostics, forecasts and data preparation."""
