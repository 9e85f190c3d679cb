"""Training-data operators: URL filters, toxicity, decontamination, language ID,
line deduplication, source mixing, sharding, media columns, similarity joins
and personal-data spans.

Every operator is ``DataFrame -> DataFrame``.  Columns an operator adds replace
input columns of the same name; other input columns are never touched.
"""
