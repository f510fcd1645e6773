"""Training-data operators: decontamination, token files, rules, language, quality, HTML, mixing, secrets, PII, near duplicates.

Nothing outside this subpackage imports it.  Each module holds one operator with its own general interface;
``queries.py`` registers a query of each over whole tables, and SQL for what SQL can say of them.
"""
