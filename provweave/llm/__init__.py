"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own interface; ``entry`` registers the thin ``opN_<name>`` queries.
"""
