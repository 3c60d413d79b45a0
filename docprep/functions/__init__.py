"""Column functions: everything here takes and returns Columns."""

from docprep.functions import html, predicates, scalars, text

__all__ = ["html", "predicates", "scalars", "text"]
