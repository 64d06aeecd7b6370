"""Training-data operators: tokens, language, leaks, near copies, filters, mixing.

Nothing else in the package imports this subpackage; it can be removed as a whole.
"""
