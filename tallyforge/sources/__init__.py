"""Readers, writers and content fingerprints."""

from tallyforge.sources.readers import read_csv, read_dataset, read_excel_folder, read_json, read_table
from tallyforge.sources.writers import persist_sections, write_csv

__all__ = [
    "read_csv", "read_dataset", "read_excel_folder", "read_json", "read_table", "persist_sections", "write_csv",
]
