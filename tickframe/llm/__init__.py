"""Training-data operators: each module is one operator with its general interface.

``queries.py`` registers one query per operator and the pipeline; nothing outside this
subpackage imports it.
"""
