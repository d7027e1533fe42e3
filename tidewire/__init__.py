"""Message intelligence on PySpark: DataFrame -> DataFrame operators, in batch and in streams."""
