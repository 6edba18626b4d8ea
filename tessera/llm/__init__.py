"""Training-data operators: ten operators over text, page, chat and image tables.

Nothing outside this subpackage imports it.  ``tessera.llm.registry`` lists the
``opN_<name>`` queries and the SQL they are compared with.
"""
