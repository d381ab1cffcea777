"""loamstone: retrieval, memory and graph analytics as PySpark DataFrame operators."""
