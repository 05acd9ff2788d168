"""Column functions over text and the rule tables they take as data."""
