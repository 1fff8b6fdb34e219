"""Column expressions. None of them needs Python on the executors."""
