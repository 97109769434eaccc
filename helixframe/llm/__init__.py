"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage; its queries are in
``queries.py`` and are registered by ``__spark_entry__.py`` when the
subpackage can be imported.
"""
