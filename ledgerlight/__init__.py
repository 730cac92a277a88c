"""ledgerlight: explainable oversight analytics as Spark DataFrame plans."""
