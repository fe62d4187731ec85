"""A Spark-native engine for a language that navigates, filters, aggregates,
joins, reshapes and patches JSON-like data."""
