"""The registered queries and the SQL that says the same."""
