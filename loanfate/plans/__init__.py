"""Whole studies: from raw loans to the table a study reports."""
