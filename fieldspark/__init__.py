"""fieldspark: gridded-field analytics as composable PySpark DataFrame transformations."""
