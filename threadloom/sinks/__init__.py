"""Writers for tables, files and messages."""
