"""A PySpark engine for versioned AI trace records."""
