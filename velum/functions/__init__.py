"""Builders of Spark SQL expressions.

Each function takes SQL expressions as text (most often a column name) and returns
one, for ``F.expr`` or ``selectExpr``. Text is used because the larger expressions
have thousands of nodes: as one string they are parsed at once, while a chain of
``Column`` calls makes several driver round trips per node."""
