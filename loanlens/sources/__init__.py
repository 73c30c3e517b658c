"""Sources and sinks: driver tables, the applications view, files, model state."""
from loanlens.sources.tables import applications, read_table

__all__ = ["applications", "read_table"]
