"""plans of the medallion layers."""
