"""Streaming: the operator inventory has none.

Late data is a batch matter here: a source that arrives a day later leaves the last day incomplete, which
``operators.combine`` marks (``combine_members``, ``completeness``) instead of holding state for it.
"""
