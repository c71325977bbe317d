"""Training-data operators: quality, chat, URL, token, archive, near-duplicate, decontamination and sharding jobs.

Nothing outside this subpackage imports it; removing the folder leaves the rest of the library intact.
"""
