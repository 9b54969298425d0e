"""Ready-made queries over the sample tables, each with the SQL that states its answer."""
