"""Training-data operators over the ``documents`` table (see ``queries.py``).

Nothing else in the library imports this subpackage; it may import general
helpers from the library.
"""
