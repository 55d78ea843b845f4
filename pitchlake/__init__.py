"""PySpark jobs for football data at scale: every job is a DataFrame-to-DataFrame function."""

ANALYTICS_VERSION = "pitchlake-1"
