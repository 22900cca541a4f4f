"""Statement analytics and privacy decisions as Spark DataFrame plans."""
