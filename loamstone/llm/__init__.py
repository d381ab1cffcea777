"""Training-data operators. Nothing outside this subpackage imports it, but for the guard in ``__spark_entry__``."""
