"""corpusloom: a Spark-first engine for research-corpus analytics and corpus preparation."""
