"""Operators for preparing training corpora at scale.

Nothing outside this folder imports it; ``registry`` lists its queries.
"""
