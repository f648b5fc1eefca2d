"""terrafolio: property-market analytics as lazy PySpark DataFrame operators."""
