"""tallyspark: DataFrame operators for large collections of report text and the figures read from them."""
