"""textloom: text analytics and corpus preparation as lazy Spark DataFrame transforms."""
