"""Training-data operators: each module holds one operator; ``queries`` registers them.

Nothing else in the library imports this subpackage.
"""
