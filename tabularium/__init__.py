"""tabularium: a PySpark-native engine for self-describing block tables with key indexes and blob files."""
