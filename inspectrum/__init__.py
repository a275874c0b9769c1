"""inspectrum: vehicle-inspection analytics on PySpark DataFrames."""
