"""nomenspark: variant-description analytics and text-corpus operators on PySpark."""
