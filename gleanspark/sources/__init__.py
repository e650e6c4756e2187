"""Reading and writing the tables on disk."""
