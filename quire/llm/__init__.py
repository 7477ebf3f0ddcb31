"""Training-data operators: ten stand-alone components that nothing else in the library imports."""
