"""Training-data operators on the text of a document collection.

Nothing outside this subpackage imports it.
"""
