"""operators of the medallion layers."""
