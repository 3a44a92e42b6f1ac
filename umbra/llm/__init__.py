"""Operators that prepare text corpora for training language models.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; :mod:`umbra.llm.queries` derives the
registered ``opN_<name>`` digests from them.
"""
