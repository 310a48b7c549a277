"""Named queries over the star tables and the SQL that checks them."""
