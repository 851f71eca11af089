"""Reading and writing datasets, runs and catalogues."""
