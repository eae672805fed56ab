"""Column functions: predicates, text, money and dates, all JVM-side."""
