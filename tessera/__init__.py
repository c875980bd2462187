"""Search-, document- and sketch-style analytics compiled to Spark plans."""
