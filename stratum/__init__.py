"""stratum: a medallion-style analytics library on PySpark."""
