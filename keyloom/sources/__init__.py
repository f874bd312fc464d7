"""Reading tables and finding the folder that all executors share."""
