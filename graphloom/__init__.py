"""graphloom: graph retrieval analytics and corpus preparation on PySpark."""
