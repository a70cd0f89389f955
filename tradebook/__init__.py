"""Customer, job and booking records held as JSON-document tables, processed on Spark."""
