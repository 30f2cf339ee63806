"""File formats of motion capture as Spark data sources and sinks."""
