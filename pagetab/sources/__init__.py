"""Table schemas, readers, shared-folder tables and sinks."""
