"""Reading and writing: tables, item JSON, captured pages, baselines and exports."""
