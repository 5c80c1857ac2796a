"""Training-data operators over text corpora.  Nothing outside this subpackage imports it."""
