"""Operators for building training data; one module each, registered in ``registry``."""
