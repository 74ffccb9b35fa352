"""Column functions: text preparation, token shapes, stemming."""
