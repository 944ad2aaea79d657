"""vellumine.llm"""
