"""graphloom: a Spark-first engine for code graphs and corpus preparation."""
