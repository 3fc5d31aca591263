"""Curation of labelled page images and evaluation of recognition results on Spark.

Every operator takes and returns DataFrames.  Nothing data-sized passes through the
driver; the few operators that need a total order or a fixpoint cut their lineage
with reliable checkpoints (see :mod:`folioproof.plans.session`).
"""

__version__ = "0.1.0"
