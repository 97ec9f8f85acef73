"""skein: retrieval, analytics and knowledge-index jobs as Spark DataFrame transformations."""
