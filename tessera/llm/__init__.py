"""Training-data operators: mixing, personal data, deduplication, chat rendering, toxicity,
fingerprints, nearest neighbours, sharding and byte-level BPE.

Nothing outside this subpackage imports it; :mod:`tessera.llm.queries` holds the registered queries.
"""
