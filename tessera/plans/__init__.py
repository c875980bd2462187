"""From query and expression text to Spark columns and frames."""
