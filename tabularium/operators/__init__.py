"""Tables, index views, range scans and cursors as DataFrames."""
