"""Training-data operators: toxicity, near-duplicates, licences, mixing, decontamination, personal data, token files.

Nothing outside this package imports it.  ``registry`` lists the queries that ``__spark_entry__`` adds.
"""
