"""Jobs with a command line; the registered queries call the same functions."""
