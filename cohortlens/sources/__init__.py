"""Where the eleven input tables come from."""

from cohortlens.sources.derived import derived_tables, fingerprint, stored_tables, tables_by_programme
from cohortlens.sources.tables import Tables, catalog_tables, frame_tables, parquet_tables

__all__ = [
    "Tables",
    "catalog_tables",
    "derived_tables",
    "fingerprint",
    "frame_tables",
    "parquet_tables",
    "stored_tables",
    "tables_by_programme",
]
