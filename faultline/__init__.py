"""Point-in-time corporate-risk analytics as Spark DataFrame plans."""
