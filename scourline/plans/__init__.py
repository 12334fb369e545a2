"""Plan builders and the tables that cut lineage between their parts."""
