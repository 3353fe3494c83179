"""Column access by exact name."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """Column called ``name`` even when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")
