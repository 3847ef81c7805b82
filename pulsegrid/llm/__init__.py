"""Operators for preparing training corpora.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries when the subpackage is present.
"""
