"""Sources, views and sinks."""
