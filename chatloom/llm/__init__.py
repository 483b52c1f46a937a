"""Training-data operators (quality, dedup, decontamination, mixing, WARC, secrets).

Nothing else in the package imports this subpackage; its queries are added to
the driver contract only when it is present.
"""
