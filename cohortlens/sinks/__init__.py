"""Writers: report tables, documents with a manifest, and the reusable snapshot."""

from cohortlens.sinks.snapshot import MAX_AGE, expire, snapshot
from cohortlens.sinks.writers import (
    read_documents,
    write_by_programme,
    write_documents,
    write_report,
    write_tables,
)

__all__ = [
    "MAX_AGE",
    "expire",
    "read_documents",
    "snapshot",
    "write_by_programme",
    "write_documents",
    "write_report",
    "write_tables",
]
