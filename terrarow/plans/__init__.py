"""Named queries over a table folder, and their DuckDB equivalents."""
