"""Test-only: writes block tables. The engine itself has no writer."""
