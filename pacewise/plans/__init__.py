"""Named queries over the given tables, each with SQL that states its result."""
