"""Training-data operators: dedup, quality, licences, decontamination, tokenising, sharding, exact search.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it, so it can be removed as a unit.
"""
