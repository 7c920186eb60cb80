"""Spark jobs over language-mix text corpora: cleaning, splits, features, classifiers, chat turns."""
