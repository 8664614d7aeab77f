"""tessera: point-in-time corpus analytics and data processing on PySpark."""
