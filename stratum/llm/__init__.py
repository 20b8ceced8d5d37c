"""Operators for training-data preparation at corpus scale.

Nothing else in :mod:`stratum` imports this subpackage.
"""
