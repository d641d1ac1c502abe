"""Schedule calculus and job-run analytics as PySpark DataFrame operators."""
