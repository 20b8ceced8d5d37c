"""sources of the medallion layers."""
