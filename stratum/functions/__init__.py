"""functions of the medallion layers."""
