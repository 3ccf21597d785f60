"""Place recommendation, ranking evaluation and day routes as Spark jobs."""
