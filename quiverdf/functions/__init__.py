"""Column functions over vectors (arrays of numbers) and over their codes."""
