"""drawloom: classifier workloads over vectors and labels as Spark DataFrame queries."""
