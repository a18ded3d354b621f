"""auditlake: website-audit analytics and corpus processing on Apache Spark."""

__version__ = "0.1.0"
