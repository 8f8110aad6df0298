"""The queries of the engine and the SQL that says the same."""
