from llm_cases import documents, empty, odd, provided  # noqa: F401
