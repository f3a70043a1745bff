"""Analytics for imbalanced, embedding-annotated datasets on PySpark."""
