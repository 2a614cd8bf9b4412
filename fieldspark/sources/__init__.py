"""Table loading, generated grids and text sinks."""
