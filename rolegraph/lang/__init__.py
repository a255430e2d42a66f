"""The program language: syntax tree, parser and canonical form.  Pure Python; no Spark job starts here."""
