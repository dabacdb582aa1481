"""Documentation-corpus engine expressed as PySpark DataFrame operators."""
