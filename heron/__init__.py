"""A PySpark engine for knowledge retrieval, agent memory and conversation analytics."""
