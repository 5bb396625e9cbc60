"""Registry of the layout queries and their SQL."""

from .document_queries import DOCUMENTS
from .layout_queries import LAYOUT
from .line_queries import LINES

ALL = {**LINES, **LAYOUT, **DOCUMENTS}
QUERIES = {k: f for k, (f, _) in ALL.items()}
ORACLE_SQL = {k: s for k, (_, s) in ALL.items() if s}
FLAGSHIP = "page_evaluation"
