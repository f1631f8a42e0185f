"""Training-data operators: each module holds one operator; ``queries`` wires them to the tables.

Nothing outside this subpackage imports it.
"""
