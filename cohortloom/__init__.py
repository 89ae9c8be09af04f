"""Wide cohort-table analytics as Spark jobs."""
