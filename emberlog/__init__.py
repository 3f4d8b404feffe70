"""Evidence timelines on PySpark."""
