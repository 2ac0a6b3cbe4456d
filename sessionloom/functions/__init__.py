"""Column expressions shared by the operators. None of them uses a Python UDF."""
