"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  Each operator is a module with a
general interface; its query (``opN_<name>``) and, where SQL can say it, its oracle stand at
the end of the same module.  ``registry`` gathers them.
"""
