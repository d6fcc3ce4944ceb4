"""Training-data operators: ten document-scale components, each in a module of its own.

Nothing outside this subpackage imports it.
"""
