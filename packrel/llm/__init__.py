"""Training-data operators: ten stages a corpus passes before it is used.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; :mod:`packrel.llm.queries` derives the thin ``opN_<name>`` results from them.
"""
