"""Reusable DataFrame operators.

All of them survive a key that holds a third of the rows: they aggregate before
the shuffle, cut long groups into time buckets, or join a one-row-per-key side
so that AQE can split the hot partition.
"""
