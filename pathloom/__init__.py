"""Network coverage analytics on Spark."""
