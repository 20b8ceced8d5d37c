"""streaming of the medallion layers."""
