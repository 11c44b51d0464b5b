"""Declarative rules over bodies of text files, evaluated as Spark plans."""
