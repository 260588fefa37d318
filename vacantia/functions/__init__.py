"""Functions of columns: text, analysis, markup."""
