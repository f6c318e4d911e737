"""Column functions and text helpers shared by the operators."""
