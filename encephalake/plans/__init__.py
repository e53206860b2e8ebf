"""Composed plans and the views of the driver's tables they run on."""
