"""Media-operations analytics on PySpark: DataFrame in, DataFrame out."""
