"""Training-data operators over document, page and benchmark tables.

Nothing else in the library imports this subpackage; the driver entry point adds
its queries when it is present.
"""
