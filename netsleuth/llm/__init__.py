"""Operators for building training corpora: archives, language, quality,
de-duplication, tokenisation and packing.  Nothing else in the package imports
this subpackage."""
