"""quire: a library of converted technical documents as Spark tables, and the questions asked of it."""
