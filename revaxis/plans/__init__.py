"""Reports composed from the operators; every section is its own lazy DataFrame."""
