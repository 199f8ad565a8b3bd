"""Cohort analytics on Spark: cleaning, linking, uptake tables, disclosure control and group statistics."""
