"""Training-data pipeline operators.

Ten operators over documents, pages and conversations.  Nothing else in the
library imports this subpackage; ``docweave.llm.queries`` registers the queries.
"""
