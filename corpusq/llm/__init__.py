"""Training-data operators: de-duplication, packing, classifiers, scans, extraction, archives.

Nothing outside this package imports it; the repository works without it.
"""
