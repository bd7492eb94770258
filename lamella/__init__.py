"""lamella: analytics over tiled, multi-resolution image pyramids, on PySpark."""
