"""Operators for preparing language-model training corpora, as DataFrame plans.

Nothing outside this package imports it; ``queries`` lists what it registers.
"""
