"""feathergrid: DataFrame operators for features, models and back-tests on Spark."""
