"""Jobs that are run from the command line."""
