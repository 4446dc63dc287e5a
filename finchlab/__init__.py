"""Social-text analytics and classification as PySpark jobs."""
