"""Writers: texts are made by expressions and ordered aggregates; each document is one row until it is written."""
