"""Named queries over the order/customer test tables, and the SQL that checks them."""
