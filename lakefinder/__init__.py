"""lakefinder: table discovery over a data lake, as Spark plans."""
