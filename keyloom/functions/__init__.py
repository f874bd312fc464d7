"""Column functions shared by the operators and the SQL dialect."""
