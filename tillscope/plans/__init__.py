"""Views over the tables and the registered queries."""
