"""Field-trial analytics expressed as Spark DataFrame transformations."""
