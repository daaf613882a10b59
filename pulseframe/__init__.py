"""Analytics for wearable-sensor and training history on Spark."""
