"""File-stream forms of ingestion and log reading."""
