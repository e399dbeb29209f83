"""Training-data operators: quality, decontamination, toxicity, personal data, tokens, neighbours, duplicates, licences.

Nothing outside this folder (and `corpus_pipeline.py`) imports it.
"""
