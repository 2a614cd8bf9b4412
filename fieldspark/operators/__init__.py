"""DataFrame -> DataFrame operators on long-format fields."""
