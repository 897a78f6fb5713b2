"""brindle: hybrid retrieval, document analytics and corpus operators as Spark jobs."""
