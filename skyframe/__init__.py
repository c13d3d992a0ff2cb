"""Sky maps as DataFrames: pixel geometry, regions, map algebra, harmonics and FITS on Spark."""
