"""Event, embedding and document analytics on Spark."""
