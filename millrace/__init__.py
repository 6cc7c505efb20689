"""A data stewardship engine on Spark."""
