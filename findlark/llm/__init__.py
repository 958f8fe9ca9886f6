"""Training-data operators: extraction, packing, language ID, secrets, quality,
similarity, toxicity, chat formatting, decontamination and LM scoring.

Nothing outside this subpackage imports it.
"""
