"""Operators for preparing language-model training data at scale.

One module per operator; ``catalog`` registers their queries.  Nothing outside this
subpackage (and ``corpus_pipeline.py`` at the repository top) imports it.
"""
