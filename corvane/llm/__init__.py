"""Operators for large training-data corpora, one module each.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; the thin ``op<N>_...`` queries in :mod:`corvane.llm.queries`
derive the fixed result columns from the operators' own outputs.
"""
