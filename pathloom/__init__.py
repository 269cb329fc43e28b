"""pathloom: probabilistic map-matching and trajectory analytics on Spark."""
