"""graphloom: graph views of tables, linking, scoring and corpus preparation on Spark."""
