"""cairnwork: relational and corpus operators expressed as Spark DataFrame plans."""
