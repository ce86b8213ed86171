"""Training-data operators: filters, dedup, packing, tokenising, media, language ID, secrets.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own general interface; :mod:`corpusloom.llm.queries` binds them to the tables.
"""
