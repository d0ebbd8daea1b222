"""termflow.streaming."""
