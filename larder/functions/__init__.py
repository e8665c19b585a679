"""Part of larder; see the modules."""
