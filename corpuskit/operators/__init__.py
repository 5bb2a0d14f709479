"""operators of the core, see the modules."""
