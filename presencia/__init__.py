"""Presence/absence analytics on Spark: long-form feature-by-sample tables, end to end.

Subpackages: ``sources`` (file formats), ``functions`` (Column expressions),
``operators`` (DataFrame -> DataFrame), ``kernels`` (numpy numerics for small
dense problems), ``streaming`` and ``plans`` (the registered queries).
"""
