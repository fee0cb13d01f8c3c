"""Named queries over the supplied tables, each with the SQL it is checked against."""
