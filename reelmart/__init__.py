"""Movie-analytics warehouse jobs as Spark DataFrame functions."""
