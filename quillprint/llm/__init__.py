"""Operators for preparing language-model training data.

Nothing outside this package imports it. Each module holds one operator;
``queries`` applies them to the driver's tables.
"""
