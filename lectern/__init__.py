"""lectern: lesson-text analytics expressed as Spark DataFrame plans."""
