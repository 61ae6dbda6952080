"""PySpark-native analytics for classified adverts: sources, comparables, price book, decisions, dedupe, streams."""
