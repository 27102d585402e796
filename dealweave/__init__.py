"""dealweave: matching, ranking and upkeep of item lists against changing offers, as Spark jobs."""
