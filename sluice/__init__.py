"""sluice: request-cache, routing and training-data analytics on Spark."""
