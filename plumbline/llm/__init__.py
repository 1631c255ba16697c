"""Operators for preparing training data at scale: one module each, each a DataFrame -> DataFrame function.

The queries registered with the driver are in :mod:`plumbline.llm.queries`.
"""
