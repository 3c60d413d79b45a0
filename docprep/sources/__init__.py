"""Readers and writers."""

from docprep.sources.catalogue import Catalogue, read_catalogue
from docprep.sources.configs import normalise, read_configs, reserved_violations, write_configs
from docprep.sources.files import export_table, file_inventory, read_chapters, read_documents
from docprep.sources.packages import read_packages

__all__ = [
    "Catalogue",
    "export_table",
    "file_inventory",
    "normalise",
    "read_catalogue",
    "read_chapters",
    "read_configs",
    "read_documents",
    "read_packages",
    "reserved_violations",
    "write_configs",
]
