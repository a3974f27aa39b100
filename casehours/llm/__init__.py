"""Training-data operators: sharding, language ID, token files, deduplication, archives, BPE, chat, decontamination.

Nothing outside this subpackage imports it.
"""
