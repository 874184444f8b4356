"""Training-data operators: ten distributed text operators for very large corpora.

The rest of the library never imports this subpackage.
"""
