"""Operators for preparing training data.  Nothing outside this folder imports it.

Every operator selects the columns it needs by name first, so further input columns never clash with its own.
"""
