"""DataFrame -> DataFrame operators on the long fact (year, pupil, provider, subject, points)."""
