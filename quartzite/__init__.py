"""quartzite: data-quality, entity-resolution and corpus operators on PySpark DataFrames."""
