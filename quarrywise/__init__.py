"""quarrywise: a text-corpus engine expressed as Spark DataFrame plans."""
