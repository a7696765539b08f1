"""Find, classify, pseudonymise and restore sensitive values in Spark tables and streams."""

__version__ = "0.1.0"
