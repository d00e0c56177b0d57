"""tracetide: temporal change-log analytics as ordinary Spark DataFrames."""
