"""Ancient Greek vowel-length analytics on Spark."""
