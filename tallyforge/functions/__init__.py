"""Column expressions and small frame helpers shared by every operator."""
