"""The library's queries over the given tables, each with SQL where SQL expresses it."""

from .pieces import QUERIES as _PIECES
from .records import QUERIES as _RECORDS
from .search import QUERIES as _SEARCH
from .stored import QUERIES as _STORED

QUERIES = {**_SEARCH, **_RECORDS, **_PIECES, **_STORED}
