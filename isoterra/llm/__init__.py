"""Operators that prepare map texts (responses, place names, exports, logs) for training language models.

Every module holds one operator; `queries` applies them to the given tables. Nothing outside this
package imports it.
"""
