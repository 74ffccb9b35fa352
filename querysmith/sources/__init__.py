"""Reading and writing of tables, configurations and run results."""
