"""Functions of the package; see the modules."""
