"""Reading the datasets that checks look at, and writing and reading results."""
