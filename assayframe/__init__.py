"""assayframe: evaluation analytics as Spark DataFrame transformations."""
